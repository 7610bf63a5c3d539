"""Settings. All of them change results, so a configuration has a fingerprint."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field, replace

#: Fields in the order in which they form a document, with the prefixes of their exported tokens. Fixed values.
PREFIXES = {"overview": "ov", "keywords": "kw", "genres": "gn", "cast": "cast", "director": "dir"}
FIELDS = tuple(PREFIXES)

#: Words of closed classes that an overview doesn't keep. Fixed values.
FUNCTION_WORDS = tuple(
    """a an the and or but nor so yet if because as until while whereas although though since unless when where
    whether that which who whom whose of in on at to for with without from into onto upon about against between
    among over under above below by through is are was were be been being am has have had do does did it its he
    him his she her hers they them their theirs we us our ours you your yours i me my mine not no""".split()
)

#: Keyword labels that say how a film ends, compared without spaces. Fixed values.
STINGERS = ("duringcreditsstinger", "aftercreditsstinger", "beforecreditsstinger")

#: The representations: more fields from one to the next. Fixed values.
REPRESENTATIONS = {"A": ("overview",), "B": ("overview", "genres"), "C": ("overview", "genres", "keywords"), "D": FIELDS}

#: One norm for each field, or one for the whole item. Fixed values.
BLOCK_MODES = ("per_block", "flat")

CUTOFFS = (5, 10, 20)
THIN_TERMS = 3
GROUP_SIZE = 2
LABEL_KINDS = ("franchise", "director", "cast", "same_title")
SELECTED_GENRE_WEIGHT, SELECTED_SHARED_TERMS = 0.44, 3


@dataclass(frozen=True)
class FieldConfig:
    min_df: int = 1
    min_token_length: int = 2
    weight: float = 1.0
    top_k: int | None = None
    drop_function_words: bool = False


@dataclass(frozen=True)
class Config:
    unicode_form: str | None = "NFC"
    min_overview_chars: int = 40
    keep_digits: bool = True
    block_mode: str = "per_block"
    sublinear_tf: bool = True
    fields: dict[str, FieldConfig] = field(
        default_factory=lambda: {
            "overview": FieldConfig(min_df=2, drop_function_words=True),
            "keywords": FieldConfig(min_df=2),
            "genres": FieldConfig(),
            "cast": FieldConfig(min_df=2, top_k=5),
            "director": FieldConfig(min_df=2, top_k=3),
        }
    )

    def with_field(self, name: str, **changes) -> Config:
        return replace(self, fields=self.fields | {name: replace(self.fields[name], **changes)})

    def fingerprint(self) -> str:
        """SHA-256 of the settings as JSON with sorted keys."""
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()
