"""Secret scans by a trigram inverted index, with built-in functions only.

From each rule's regex a Boolean query over trigrams is derived: strings that
every match must hold, as an AND of ORs of ANDs. The index has a posting
(trigram, document) for every trigram that some query names; intersecting the
postings leaves candidates, and only these are searched with the regex. Rules
whose regex demands no trigram search every text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as op
from re import _parser as regex_tree

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free, written


@dataclass(frozen=True)
class Rule:
    """A kind of secret. Of the matches of ``regex`` those count whose group ``group`` has ``least`` characters."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1


#: Kinds in the order in which spans with one start are listed.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),  # the first AKIA of a run is the longest, so a shorter one hides none
    Rule("hex", r"[0-9a-f]{32,}"),
)
MORE_RULES = (
    Rule("forge", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("maps", r"AIza[A-Za-z0-9_-]{35,}"),
    Rule("payment", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("key_block", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)
RULES = BASE_RULES + MORE_RULES
#: Strings followed at once while a query is derived; more of them are cut into trigrams early.
MOST_STRINGS = 32

Query = frozenset[frozenset[frozenset[str]]]  # AND of ORs of ANDs of trigrams


def trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def trigram_query(regex: str) -> Query:
    """The trigrams (in lower case) that every match of ``regex`` demands; empty if none."""
    clauses: set[frozenset[frozenset[str]]] = set()

    def cut(strings: set[str]) -> None:
        need = {trigrams(s) for s in strings}
        need = frozenset(n for n in need if not any(other < n for other in need))
        if need and frozenset() not in need:
            clauses.add(need)

    def spelled(items) -> set[str] | None:
        """All strings a part of the regex may match, if they are few."""
        found = {""}
        for kind, value in items:
            if kind is op.LITERAL:
                some = {chr(value).lower()}
            elif kind is op.IN and all(k is op.LITERAL for k, _ in value):
                some = {chr(v).lower() for _, v in value}
            elif kind is op.SUBPATTERN:
                some = spelled(value[3])
            elif kind is op.BRANCH:
                arms = [spelled(arm) for arm in value[1]]
                some = None if None in arms else set().union(*arms)
            elif kind is op.MAX_REPEAT and value[1] == 1:
                some = spelled(value[2])
                some = None if some is None else some | ({""} if value[0] == 0 else set())
            elif kind is op.MAX_REPEAT and value[0] == value[1] <= 8:
                some = spelled(list(value[2]) * value[0])
            else:
                some = None
            if some is None or len(found) * len(some) > MOST_STRINGS:
                return None
            found = {a + b for a in found for b in some}
        return found

    def walk(items) -> None:
        held = {""}
        for item in items:
            kind, value = item
            some = spelled([item])
            if some is not None and len(held) * len(some) <= MOST_STRINGS:
                held = {a + b for a in held for b in some}
                continue
            cut(held)
            held = some or {""}
            if some is None and kind is op.SUBPATTERN:
                walk(value[3])
            elif some is None and kind is op.MAX_REPEAT and value[0] > 0:
                walk(value[2])
        cut(held)

    walk(list(regex_tree.parse(regex)))
    return frozenset(clauses)


def postings(docs: DataFrame, rules: tuple[Rule, ...], id_col: str, text_col: str) -> DataFrame:
    """The inverted index ``trigram, doc`` over the trigrams that the rules' queries name."""
    named = sorted({t for r in rules for clause in trigram_query(r.regex) for need in clause for t in need})
    text = F.lower(F.col(f"`{text_col}`").cast("string"))
    held = F.filter(F.array(*map(F.lit, named)), lambda t: F.contains(F.col("low"), t)) if named else F.array().cast("array<string>")
    return docs.select(F.col(f"`{id_col}`").alias("doc"), text.alias("low")).where("doc IS NOT NULL").select("doc", F.explode(held).alias("trigram"))


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``doc, rules``: the rules (by number) whose queries the document's postings satisfy."""
    held = index.groupBy("doc").agg(F.collect_set("trigram").alias("held"))  # as many as the rules name, at most

    def satisfied(query: Query) -> Column:
        out = F.lit(True)
        for clause in sorted(query, key=lambda c: sorted(map(sorted, c))):
            some = F.lit(False)
            for need in sorted(clause, key=sorted):
                some |= F.size(F.array_intersect("held", F.array(*map(F.lit, sorted(need))))) == len(need)
            out &= some
        return out

    hits = [F.when(satisfied(q), F.lit(i)) for i, r in enumerate(rules) if (q := trigram_query(r.regex))]
    return held.select("doc", F.array_compact(F.array(*hits) if hits else F.array().cast("array<int>")).alias("rules")).where(F.size("rules") > 0)


def _spans(text: Column, number: int, rule: Rule) -> Column:
    """``array<struct<start, kind, end>>`` of the matches, in code points."""
    regex = F.lit(rule.regex)
    empty = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    found = F.regexp_extract_all(text, regex, F.lit(0))
    judged = F.regexp_extract_all(text, regex, F.lit(rule.group))
    # the text between the matches, which split() leaves, gives their places
    steps = F.arrays_zip(
        F.slice(F.split(text, rule.regex, -1), F.lit(1), F.size(found)).alias("gap"), found.alias("match"), judged.alias("judged")
    )
    begin = F.struct(F.lit(0).alias("at"), empty.alias("out"))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["gap"])
        end = start + F.length(x["match"])
        span = F.array(F.struct(start.alias("start"), F.lit(number).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(F.length(x["judged"]) >= rule.least, F.concat(state["out"], span)).otherwise(state["out"]).alias("out"))

    return F.when(F.regexp_like(text, regex), F.aggregate(steps, begin, step, lambda s: s["out"])).otherwise(empty)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows and columns, with ``secret_spans`` added (or replaced).

    It is an array of ``start, kind, end``: code points, end exclusive, kind as
    a number into ``rules``, in the order of start and kind. Matches of one rule
    do not overlap; those of several may. Null and empty texts have none. Rows
    with a null id are searched by every rule; rows that share an id are
    candidates together and searched apart. ``id_col`` may have any type. An
    empty table gives no rows; a text is one row's work, however long; no
    column but ``secret_spans`` is touched.
    """
    keep = [c for c in docs.columns if c != "secret_spans"]
    index = written(postings(docs, rules, id_col, text_col), "trigrams")
    doc, may = free("doc", docs), free("rules", docs)
    # written, so that the planner knows the size: a small table is sent to the texts, and
    # only one too large for that makes them move
    found = written(candidates(index, rules).withColumnsRenamed({"doc": doc, "rules": may}), "secret-candidates")
    joined = docs.select(*(F.col(f"`{c}`") for c in keep)).join(found, F.col(f"`{id_col}`") == F.col(doc), "left")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    spans = []
    for i, rule in enumerate(rules):
        own = _spans(text, i, rule)
        if trigram_query(rule.regex):
            searched = F.col(f"`{id_col}`").isNull() | F.coalesce(F.array_contains(may, F.lit(i)), F.lit(False))
            own = F.when(searched, own).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int>>"))
        spans.append(own)
    return joined.select(*(F.col(f"`{c}`") for c in keep), F.array_sort(F.flatten(F.array(*spans))).alias("secret_spans"))


def listed(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Spans as text: ``kind:start:end``, joined by commas."""
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])), ",")


def masked(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span (overlapping ones together) replaced by ``mark``."""

    def step(state: Column, s: Column) -> Column:
        apart = s["start"] >= state["at"]
        more = F.concat(state["out"], F.substring(text, state["at"] + 1, s["start"] - state["at"]), F.lit(mark))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(apart, more).otherwise(state["out"]).alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    ended = F.aggregate(spans, begin, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, ended).otherwise(text)
