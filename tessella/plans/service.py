"""The serving surface as plain Python: limits, typed errors, and one DataFrame for each answer."""

from __future__ import annotations

import logging
import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tessella.operators import retrieve, vectorise
from tessella.operators.search import TitleIndex
from tessella.plans.config import SELECTED_GENRE_WEIGHT, SELECTED_SHARED_TERMS, Config
from tessella.sources import artefacts
from tessella.sources.scratch import Scratch


class ServiceError(Exception):
    """An answer that can't be given; code and status name the reason."""

    code, status = "internal_error", 500

    def __init__(self, message: str = "", **details):
        super().__init__(message or self.code.replace("_", " "))
        self.details = details

    def envelope(self) -> dict:
        body = {"code": self.code, "message": str(self), "status": self.status}
        return {"error": body | ({"details": self.details} if self.details else {})}


def _error(code: str, status: int) -> type[ServiceError]:
    return type("".join(p.title() for p in code.split("_")), (ServiceError,), {"code": code, "status": status})


#: Codes and statuses of answers that can't be given. Fixed values.
EmptyQuery, QueryTooLong = _error("empty_query", 400), _error("query_too_long", 400)
InvalidK, InvalidLimit, InsufficientFeatures = _error("invalid_k", 422), _error("invalid_limit", 422), _error("insufficient_features", 422)
ValidationError, UnknownItem, CatalogueUnavailable = _error("validation_error", 422), _error("unknown_movie", 404), _error("catalogue_unavailable", 503)
NotFound, MethodNotAllowed = _error("not_found", 404), _error("method_not_allowed", 405)
#: Rows of the list of skipped candidates that an answer shows at a time; the next ones follow when asked for.
SKIPPED_PAGE = 1_000


@dataclass(frozen=True)
class Limits:
    default_k: int = 10
    max_k: int = 50
    default_limit: int = 10
    max_limit: int = 50
    max_query_length: int = 200


def _whole(value, name: str) -> int:
    """A whole number, or digits that say one."""
    if isinstance(value, str) and value.strip().lstrip("+-").isdecimal():
        return int(value)
    if isinstance(value, bool) or not isinstance(value, int):
        raise ValidationError(f"{name} isn't a whole number", **{name: str(value)})
    return value


class Catalogue:
    """Feature records and their weights, computed or read once and kept; answers never change them."""

    def __init__(self, features: DataFrame, config: Config | None = None, limits: Limits | None = None, min_shared: int = SELECTED_SHARED_TERMS, min_score: float = 0.0, matrix: artefacts.Matrix | None = None, titles: TitleIndex | None = None):
        began = time.perf_counter()
        self.config = config or Config().with_field("genres", weight=SELECTED_GENRE_WEIGHT)
        self.limits, self.min_shared, self.min_score = limits or Limits(), min_shared, min_score
        self.features = features.persist()
        self.weights = (matrix.weights if matrix else vectorise.representation(self.features, self.config)).persist()
        self.rows = matrix.rows if matrix else self.weights
        self._titles, self._scratch = titles, None
        self.load_seconds = time.perf_counter() - began

    @classmethod
    def load(cls, spark: SparkSession, path: str, config: Config | None = None, **settings) -> Catalogue:
        """A catalogue from what save() wrote, without computing a weight; CatalogueUnavailable says what is missing, empty or of other settings."""
        config = config or Config().with_field("genres", weight=SELECTED_GENRE_WEIGHT)
        try:
            features = artefacts.read_corpus(spark, path)
            matrix = artefacts.load_matrix(spark, f"{path}/matrix", config)
            titles = TitleIndex.read(spark, f"{path}/titles") if artefacts.exists(spark, f"{path}/titles/grams") else None
        except (artefacts.MissingArtefact, ValueError) as e:
            raise CatalogueUnavailable(str(e)) from e
        if features.isEmpty():
            raise CatalogueUnavailable(f"{path} holds no items")
        return cls(features, config, matrix=matrix, titles=titles, **settings)

    @staticmethod
    def save(features: DataFrame, path: str, config: Config | None = None) -> dict:
        """Writes features, weights, vocabulary and the index of titles for load(), and returns the corpus manifest."""
        config = config or Config().with_field("genres", weight=SELECTED_GENRE_WEIGHT)
        manifest = artefacts.write_corpus(features, path, config)
        stored = artefacts.read_corpus(features.sparkSession, path)
        artefacts.save_matrix(stored, config, f"{path}/matrix")
        TitleIndex.write(stored, f"{path}/titles")
        return manifest

    def close(self) -> None:
        self.weights.unpersist()
        self.features.unpersist()
        if self._scratch:
            self._scratch.delete()

    @property
    def titles(self) -> TitleIndex:
        """The index of titles; without a stored one it is written to the scratch folder at the first search, and deleted by close()."""
        if self._titles is None:
            self._scratch = Scratch(self.features.sparkSession, "titles")
            self._titles = TitleIndex.write(self.features, self._scratch.root)
        return self._titles

    def health(self) -> dict:
        return {"status": "ok"}

    def ready(self) -> dict:
        """Whether there is anything to answer from."""
        if self.features.isEmpty():
            raise CatalogueUnavailable()
        return {"status": "ready"}

    def stats(self) -> dict:
        """Size of the catalogue, and the time that it took to set up."""
        shape = vectorise.geometry(self.weights, self.features).first()
        return {"items": shape["items"], "dimensions": shape.dimensions, "nonzeros": shape.nonzeros, "density_pct": shape.density_pct, "load_seconds": round(self.load_seconds, 4)}

    def meta(self) -> DataFrame:
        """One row: the matrix's geometry, the gates, the limits and the configuration's fingerprint."""
        extra = {"min_shared_terms": self.min_shared, "default_k": self.limits.default_k, "max_k": self.limits.max_k, "fingerprint": self.config.fingerprint()}
        return vectorise.geometry(self.weights, self.features).withColumns({k: F.lit(v) for k, v in extra.items()})

    def search(self, query: str, limit: int | None = None) -> DataFrame:
        if not isinstance(query, str) or not query.strip():
            raise EmptyQuery()
        if len(query) > self.limits.max_query_length:
            raise QueryTooLong(length=len(query), max_query_length=self.limits.max_query_length)
        limit = self.limits.default_limit if limit is None else _whole(limit, "limit")
        if not 1 <= limit <= self.limits.max_limit:
            raise InvalidLimit(limit=limit)
        return self.titles.search(query, limit)

    def _terms(self, item_id: int) -> Column:
        """Whether an item has terms, as a column of its own row's plan."""
        return self.rows.where(F.col("item_id") == item_id).limit(1).agg(F.count("*")).scalar() > 0

    def _row(self, item_id: int) -> Row:
        """All that is shown of an item, in one job."""
        counts = F.map_from_entries(F.array(*(F.struct(F.lit(f).alias("k"), F.size(f"tokens.{f}").alias("v")) for f in self.config.fields)))
        found = self.features.where(F.col("id") == item_id)
        row = retrieve.metadata(found, feature_counts=counts, recommendable=self._terms(item_id)).first()
        if row is None:
            raise UnknownItem(item_id=item_id)
        return row

    def details(self, item_id: int) -> DataFrame:
        """One row of metadata, with feature_counts and recommendable."""
        row = self._row(item_id)
        kinds = retrieve.metadata(self.features, feature_counts=F.lit(None).cast("map<string,int>"), recommendable=F.lit(True)).schema
        return self.features.sparkSession.createDataFrame([row], kinds)

    def _scored(self, item_id: int, k: int | None) -> tuple[DataFrame, DataFrame, int]:
        """(scores, query, k) of one item; k is checked before the id, and one job says whether the item is there and has terms."""
        k = self.limits.default_k if k is None else _whole(k, "k")
        if not 1 <= k <= self.limits.max_k:
            raise InvalidK(k=k)
        query = self.features.where(F.col("id") == item_id).select(F.col("id").alias("query_id"))
        known = query.select(self._terms(item_id).alias("terms")).first()
        if known is None:
            raise UnknownItem(item_id=item_id)
        if not known.terms:
            raise InsufficientFeatures(item_id=item_id)
        return retrieve.scores(self.weights, query, rows=self.rows), query, k

    def _judged(self, scored: DataFrame, query: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        accepted = retrieve.recommend(scored, k, self.min_score, self.min_shared)
        rejected = retrieve.skipped(scored, k, self.min_score, self.min_shared)
        return retrieve.with_metadata(accepted, self.features), rejected, retrieve.evidence(accepted, rejected, query, k, self.min_shared)

    def recommend(self, item_id: int, k: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(recommendations with metadata, skipped, evidence) of one item; k is checked before the id."""
        return self._judged(*self._scored(item_id, k))

    def recommend_many(self, item_ids: list[int], k: int | None = None) -> DataFrame:
        """Recommendations of several items in one plan; one unknown id fails all."""
        k = self.limits.default_k if k is None else _whole(k, "k")
        if not 1 <= k <= self.limits.max_k:
            raise InvalidK(k=k)
        asked = self.features.sparkSession.createDataFrame([(i,) for i in item_ids], "query_id long")
        missing = asked.join(self.features.select(F.col("id").alias("query_id")), "query_id", "left_anti").take(1)
        if missing:
            raise UnknownItem(item_id=missing[0].query_id)
        return retrieve.recommend(retrieve.scores(self.weights, asked, rows=self.rows), k, self.min_score, self.min_shared)

    def answer(self, method: str, path: str, **asked) -> tuple[int, dict]:
        """(status, payload) of a request: health, ready, meta, stats, movies/search?q=&limit=, movies/<id>, movies/<id>/recommendations?k=&skipped_after=.

        Payloads are plain values; their sizes are bounded by the limits and SKIPPED_PAGE: skipped_next is the place after which the next page of skipped candidates begins, null where there is
        none. Every error has the same envelope, and what
        wasn't foreseen is an internal_error without details.
        """
        try:
            return 200, self._answer(method, [p for p in path.split("/") if p], asked)
        except ServiceError as e:
            return e.status, e.envelope()
        except Exception:  # noqa: BLE001 - the caller learns that it failed, the log why
            logging.getLogger(__name__).exception("%s %s", method, path)
            return ServiceError.status, ServiceError().envelope()

    def _answer(self, method: str, path: list[str], asked: dict) -> dict:
        rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]
        plain = {"health": self.health, "ready": self.ready, "stats": self.stats, "meta": lambda: rows(self.meta())[0]}
        known = len(path) == 1 and path[0] in plain or path[:1] == ["movies"] and (len(path) == 2 or len(path) == 3 and path[2] == "recommendations")
        if not known:
            raise NotFound("/".join(path))
        if method.upper() != "GET":
            raise MethodNotAllowed(method)
        if path[0] in plain:
            return plain[path[0]]()
        if path[1] == "search" and len(path) == 2:
            found = rows(self.search(asked.get("q", ""), asked.get("limit")))
            return {"query": asked.get("q"), "total_matches": found[0]["total_matches"] if found else 0, "count": len(found), "results": [{k: v for k, v in r.items() if k != "total_matches"} for r in found]}
        item = _whole(path[1], "movie_id")
        if len(path) == 2:
            return self._row(item).asDict(recursive=True)
        after = _whole(asked.get("skipped_after", 0), "skipped_after")
        scored, query, k = self._scored(item, asked.get("k"))
        scored = scored.persist()  # all parts of the answer read one item's scores
        try:
            accepted, rejected, evidence = self._judged(scored, query, k)
            shown = rows(rejected.where(F.col("place") > after).orderBy("place").limit(SKIPPED_PAGE).drop("query_id"))
            more = shown[-1]["place"] if len(shown) == SKIPPED_PAGE else None
            return {"query": item, "evidence": rows(evidence)[0], "recommendations": rows(accepted.orderBy("rank").drop("query_id")), "skipped": shown, "skipped_next": more}
        finally:
            scored.unpersist()
