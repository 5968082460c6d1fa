"""Validated search requests and plan checks."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

MODES = ("text", "semantic", "hybrid", "browse")
SORTS = ("relevance", "best", "aesthetic", "sharpness", "cleanest", "newest")
PARTS = ("morning", "afternoon", "evening", "night")


@dataclass(frozen=True)
class SearchRequest:
    """A request with everything checked (P17, P18): limits, enumerations, types."""

    query: str = ""
    mode: str = "hybrid"
    sort: str = "relevance"
    limit: int = 50
    offset: int = 0
    semantic_weight: float = 0.5
    must: tuple[str, ...] = ()
    month_day: str | None = None
    time_of_day: str | None = None
    ranges: dict[str, tuple[float | None, float | None]] = field(default_factory=dict)
    should: tuple[str, ...] = ()
    expanded: tuple[str, ...] = ()
    faces: tuple[str, ...] = ()
    face_match: str = "all"
    has_people: bool | None = None
    similar_to: int | None = None
    semantic_profile: str = "balanced"

    def terms(self) -> list[str]:
        """Required terms, the query, optional terms, then expanded ones not yet there; eight at most."""
        out = [*self.must, *([self.query] if self.query else []), *self.should]
        seen = {t.casefold() for t in out}
        for t in self.expanded:
            if t.casefold() not in seen:
                seen.add(t.casefold())
                out.append(t)
        return out[:8]

    @classmethod
    def parse(cls, raw: dict) -> SearchRequest:
        """Build a request from untrusted input; ValueError for what cannot be meant."""
        mode, sort = raw.get("mode", "hybrid"), raw.get("sort", "relevance")
        if mode not in MODES or sort not in SORTS:
            raise ValueError("unknown mode or sort")
        limit, offset = raw.get("limit", 50), raw.get("offset", 0)
        if not isinstance(limit, int) or not isinstance(offset, int) or not 1 <= limit <= 500 or offset < 0:
            raise ValueError("limit must be 1..500 and offset not negative")
        weight = float(raw.get("semantic_weight", 0.5))
        if not 0 <= weight <= 1:
            raise ValueError("semantic_weight must be 0..1")
        terms = [str(t).strip().lower() for t in raw.get("must", []) if str(t).strip()]
        day = raw.get("month_day")
        if day is not None and not re.fullmatch(r"(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])", day):
            day = None
        part = raw.get("time_of_day") if raw.get("time_of_day") in PARTS else None
        ranges = {}
        for k, v in (raw.get("ranges") or {}).items():
            lo, hi = v
            ranges[str(k)] = (None if lo is None else float(lo), None if hi is None else float(hi))
        match, similar, people = raw.get("face_match", "all"), raw.get("similar_to"), raw.get("has_people")
        if match not in ("all", "any") or isinstance(similar, bool) or not isinstance(similar, int | None) or not isinstance(people, bool | None):
            raise ValueError("face_match must be all or any, similar_to an integer, has_people true or false")
        names = lambda k: tuple(dict.fromkeys(str(t).strip() for t in raw.get(k) or [] if str(t).strip()))
        return cls(
            str(raw.get("query", "")).strip(), mode, sort, limit, offset, weight, tuple(dict.fromkeys(terms))[:8], day, part, ranges,
            names("should"), names("expanded"), names("faces"), match, people, similar, str(raw.get("semantic_profile", "balanced")),
        )


def plan_text(df: DataFrame) -> str:
    """The formatted physical plan."""
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")  # noqa: SLF001


def has_cartesian(df: DataFrame) -> bool:
    """True if the plan holds a Cartesian product."""
    return "CartesianProduct" in plan_text(df)
