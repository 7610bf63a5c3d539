"""What records come from and go to."""
