"""The read side of a catalogue for one caller: each method is a plan under the caller's ceiling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenshelf.functions.storage import settled
from lumenshelf.operators import aggregates, exchange, projections, search, vectors
from lumenshelf.operators.filters import BadRequest, Filter, Visibility, apply_filters, visible
from lumenshelf.operators.textindex import TextSnapshot
from lumenshelf.plans import browse
from lumenshelf.sources.fixtures import Catalog


class Library:
    """A catalogue seen under a ceiling; everything it returns is lazy and shows visible assets only."""

    def __init__(self, cat: Catalog, ceiling: Visibility = Visibility(), index: TextSnapshot | None = None):
        """With a snapshot of a text index, searches read that instead of all names and texts."""
        self.cat, self.ceiling, self.index = cat, ceiling, index

    def found(self, text: str, limit: int, allowed: DataFrame) -> DataFrame:
        return self.index.search(text, limit, allowed) if self.index else search.search(self.cat, text, limit, allowed)

    @property
    def assets(self) -> DataFrame:
        return visible(self.cat, self.cat.asset, self.ceiling)

    def query(self, request: browse.QueryRequest) -> DataFrame:
        """A page by facets, or by relevance if the request has a text."""
        if not request.text:
            return browse.page(self.cat, request, self.ceiling)
        if request.descending:
            raise BadRequest("relevance has one direction")
        allowed = apply_filters(self.cat, self.assets, request.filters).select("id")
        return self.found(request.text, min(max(request.limit, 1), browse.MAX_LIMIT) + 1, allowed)

    def count(self, request: browse.QueryRequest) -> DataFrame:
        rows = browse.selected(self.cat, request, self.ceiling)
        if request.text:
            rows = rows.join(search.text_filter(self.cat, request.text), "id", "left_semi")
        return rows.agg(F.count(F.lit(1)).alias("total"))

    def hybrid(self, text: str, vectors_of: DataFrame, text_vector: list[float] | None, space: str, mode: str = "hybrid", filters: tuple[Filter, ...] = (), limit: int = 100) -> DataFrame:
        """Words, text vector and neighbours of the first word hits, fused by rank. Ceiling and filters come
        ahead of every cut: what the caller may not see takes no place in a list and seeds no search. Without a
        vector or a known space, words alone."""
        allowed = apply_filters(self.cat, self.assets, list(filters)).select("id", "filename")
        words = settled(vectors.with_rank(self.found(text, vectors.LEXICAL_CAP, allowed), *search.relevance()).select("id", "rank"))
        seen = vectors_of.join(allowed.select("id"), "id", "left_semi")
        if text_vector is not None:
            vectors.checked_vector(vectors_of, space, text_vector)
            if seen.where(F.col("space_id") == space).isEmpty():
                text_vector = None  # nothing that may be seen lies in the space
        fused = vectors.fused(vectors.hybrid_lists(words, seen, text_vector, space, mode)).join(allowed, "id")
        return fused.orderBy(F.desc("score"), "filename", "id").limit(limit)

    def get_asset(self, asset: int) -> DataFrame:
        return projections.detail(self.cat, self.assets.where(F.col("id") == asset))

    def grid(self, filters: tuple[Filter, ...] = ()) -> DataFrame:
        return projections.grid(self.cat, apply_filters(self.cat, self.assets, list(filters)))

    def find_similar(self, vectors_of: DataFrame, asset: int, k: int, filters: tuple[Filter, ...] = (), space: str | None = None) -> DataFrame:
        """Neighbours of a visible asset among visible ones; an unseen seed has none."""
        keep = apply_filters(self.cat, self.assets, list(filters))
        seed = vectors_of.join(self.assets.where(F.col("id") == asset).select("id"), "id", "left_semi")
        return vectors.nearest_to_asset(seed.unionByName(vectors_of.where(F.col("id") != asset)), asset, k, keep, space)

    def list_duplicates(self, limit: int, last: tuple[int, str] | None = None) -> DataFrame:
        return aggregates.duplicate_page(self.assets, limit, last)

    def list_near_duplicates(self, vectors_of: DataFrame, least: float = vectors.NEAR_COSINE) -> DataFrame:
        """Groups among visible assets: what is hidden connects nothing."""
        seen = vectors_of.join(self.assets.select("id"), "id", "left_semi")
        return vectors.near_groups(seen, vectors.near_links(seen, least))

    def stats(self) -> DataFrame:
        return aggregates.total_from_maintained(self.cat, self.ceiling)

    def by_media(self) -> DataFrame:
        return aggregates.by_media(self.assets)

    def top_tags(self, limit: int = aggregates.TOP_TAGS) -> DataFrame:
        return aggregates.top_tags(self.cat, self.assets, limit)

    def folders(self) -> DataFrame:
        return aggregates.folder_rollup(self.assets)

    def sources(self) -> DataFrame:
        rows = projections.redacted(self.cat.source_table)
        return rows if self.ceiling.full else rows.where(F.col("source_id").isin(sorted(self.ceiling.sources)))

    def collections(self) -> DataFrame:
        return aggregates.member_counts(self.cat, self.ceiling)

    def manifest(self, filters: tuple[Filter, ...] = ()) -> DataFrame:
        return projections.manifest(self.cat, apply_filters(self.cat, self.assets, list(filters)))

    def credits(self, filters: tuple[Filter, ...] = ()) -> DataFrame:
        return projections.credits(apply_filters(self.cat, self.assets, list(filters)))

    def sidecars(self, filters: tuple[Filter, ...] = ()) -> DataFrame:
        return exchange.sidecars(self.manifest(filters))
