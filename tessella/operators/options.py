"""Options of a search and what they leave of the candidates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions import rules as Y

# The bounds of the options, by name: length of a text, number of a list's values, range of a number.
TEXTS = {"source_id": 100, "channel": 20, "api_package": 100, "path_prefix": 500, "product_version": 50, "api_version": 50}
LISTS = {"kinds": 10, "categories": 10, "stabilities": 5, "tiers": 4}
NUMBERS = {"limit": (1, 10), "max_chars": (2000, 24_000)}
QUERY_CHARS, TIERS = 500, (1, 4)


@dataclass(frozen=True)
class SearchOptions:
    """What a batch of queries shares; None means not asked for."""

    limit: int = 5
    max_chars: int = 10_000
    kinds: tuple[str, ...] | None = None
    categories: tuple[str, ...] | None = None
    stabilities: tuple[str, ...] | None = None
    tiers: tuple[int, ...] | None = None
    source_id: str | None = None
    channel: str | None = None
    api_package: str | None = None
    path_prefix: str | None = None
    product_version: str | None = None
    api_version: str | None = None
    include_preview: bool | None = None
    include_historical: bool | None = None

    def __post_init__(self) -> None:
        for name, (low, high) in NUMBERS.items():
            value = getattr(self, name)
            if isinstance(value, bool) or not isinstance(value, int) or not low <= value <= high:
                raise ValueError(f"{name} must be {low} to {high}")
        for name, most in LISTS.items():
            if len(getattr(self, name) or ()) > most:
                raise ValueError(f"{name} may hold at most {most} values")
        for name, most in TEXTS.items():
            if len(getattr(self, name) or "") > most:
                raise ValueError(f"{name} may have at most {most} characters")
        if any(not TIERS[0] <= t <= TIERS[1] for t in self.tiers or ()):
            raise ValueError("tiers must be 1 to 4")

    @property
    def narrow(self) -> bool:
        """Whether a filter is likely to leave few candidates, so that more are fetched."""
        return bool(self.source_id or self.channel or self.api_package or self.path_prefix)

    def allowed(self, c: dict[str, Column], query: Column) -> Column:
        """Condition over candidates (columns by name in ``c``; version columns that are missing count as unknown)."""
        text = lambda v: F.lit(v or None).cast("string")
        flag = lambda v: F.lit(v).cast("boolean")
        listed = lambda v, t: F.array(*[F.lit(x) for x in v]).cast(f"array<{t}>") if v else F.lit(None).cast(f"array<{t}>")
        out = Y.preview_allowed(Y.preview_wanted(flag(self.include_preview), query, text(self.channel)), c["channel"], c["stability"])
        out &= Y.historical_allowed(flag(self.include_historical), query, c["lifecycle"])
        for name, column in (("kinds", "kind"), ("categories", "category"), ("stabilities", "stability")):
            out &= Y.member_of(listed(getattr(self, name), "string"), c[column])
        tiers = F.lit(None).cast("array<int>") if self.tiers is None else F.array(*[F.lit(t) for t in self.tiers]).cast("array<int>")
        out &= Y.tier_allowed(tiers, c["tier"])
        if self.source_id:
            out &= c["source_id"] == self.source_id
        out &= Y.same_text(text(self.channel), c["channel"]) & Y.same_text(text(self.api_package), c["api_package"])
        if self.path_prefix:
            out &= Y.path_under(F.lit(self.path_prefix), c["path"])
        return out & self.versions(c, Y.version_allowed, lambda a, b: a & b)

    def versions(self, c: dict[str, Column], rule, join) -> Column:
        """``rule`` (requested, actual) of both versions, joined."""
        actual = lambda n: c.get(n, F.lit(None).cast("string"))
        one, two = (rule(F.lit(getattr(self, n) or None).cast("string"), actual(n)) for n in ("product_version", "api_version"))
        return join(one, two)

    def version_bonus(self, c: dict[str, Column]) -> Column:
        return self.versions(c, Y.version_score, lambda a, b: a + b)


def query_error(query: Column) -> Column:
    """Why a query can't be searched; null if it can."""
    from tessella.functions import text as X

    return F.when(query.isNull() | (F.length(X.js_trim(query)) < 1) | (F.length(query) > QUERY_CHARS), F.lit(f"query must have 1 to {QUERY_CHARS} characters"))
