"""Secret scans with a trigram inverted index; DataFrame operations only.

From each rule's regular expression follow the strings that every match must hold, as a Boolean query over trigrams: any of
some sets, all trigrams of a set. The index lists, for each trigram that a query mentions, the texts with it (letters folded
to lower case); intersecting its postings gives a rule's candidates. A rule without mandatory trigrams has every text as a
candidate. Candidates are verified by running the expression over the whole text.

Offsets: the text between two matches and the matches themselves, exploded in order, add up to each match's start.
"""

from __future__ import annotations

import re
from re import _parser as sre
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from panelspark.llm.common import read_table, scratch_table


class Rule(NamedTuple):
    kind: str
    pattern: str  # what Java's and Python's expressions read alike; matches are leftmost and don't overlap
    group: int = 0
    least: int = 0  # characters of the group; shorter matches are dropped
    base: bool = False


RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    # shorter runs of digits match nothing else, so the length may stand in the expression
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+"),
)

MOST_STRINGS = 64
Query = frozenset  # any of these sets, all trigrams of a set; {frozenset()} holds for every text
EVERY: Query = frozenset([frozenset()])


# ---- trigram queries --------------------------------------------------------------------------------------------------

def _fold(s: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def _least(sets) -> Query:
    sets = set(sets)
    return frozenset(s for s in sets if not any(t < s for t in sets))


def _both(a: Query, b: Query) -> Query:
    """Texts for which both hold; where that gets long, the shorter of the two, which holds for more texts."""
    if len(a) * len(b) > MOST_STRINGS:
        return min(a, b, key=len)
    return _least(s | t for s in a for t in b)


def _of_strings(strings: set[str]) -> Query:
    return _least(frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings)


def _walk(items) -> tuple[set[str] | None, Query]:
    """Of a sequence: the strings it matches, if they are few, and a query that holds for every text with a match."""
    query, run, whole = EVERY, {""}, True

    def close():
        nonlocal query, run, whole
        query, run, whole = _both(query, _of_strings(run)), {""}, False

    for op, value in items:
        name, exact, inner = str(op), None, EVERY
        if name == "LITERAL":
            exact = {_fold(chr(value))}
        elif name == "IN" and all(str(o) in ("LITERAL", "RANGE") for o, _ in value):
            many = sum(1 if str(o) == "LITERAL" else v[1] - v[0] + 1 for o, v in value)
            if many <= 8:
                exact = {_fold(chr(c)) for o, v in value for c in ([v] if str(o) == "LITERAL" else range(v[0], v[1] + 1))}
        elif name == "BRANCH":
            parts = [_walk(p) for p in value[1]]
            if all(e is not None for e, _ in parts):
                exact = set().union(*(e for e, _ in parts))
            inner = _least(s for _, q in parts for s in q)
        elif name == "SUBPATTERN":
            exact, inner = _walk(value[3])
        elif name == "MAX_REPEAT":
            low, high, sub = value
            exact, inner = _walk(sub)
            if (low, high) == (0, 1) and exact is not None:
                exact = exact | {""}
            elif low == 0:
                exact, inner = None, EVERY
            elif (low, high) != (1, 1):
                if exact is not None:
                    inner = _of_strings(exact)
                exact = None
        elif name == "AT":
            continue
        if exact is not None and len(run) * len(exact) <= MOST_STRINGS:
            run = {a + b for a in run for b in exact}
        elif exact is not None:
            close()
            run = set(exact) if len(exact) <= MOST_STRINGS else {""}
        else:
            close()
            query = _both(query, inner)
    full = run if whole else None
    return full, _both(query, _of_strings(run))


def trigram_query(pattern: str) -> Query:
    """Sets of folded trigrams, of which every match of the expression holds one set whole; {frozenset()} if none is mandatory.

    Only ASCII letters are folded, in the query as in the index, so rules may ignore the case of ASCII letters.
    """
    exact, query = _walk(sre.parse(pattern))
    return _of_strings(exact) if exact is not None else query


# ---- index and scan -----------------------------------------------------------------------------------------------------

def _folded(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def trigram_index(texts: DataFrame, trigrams: list[str]) -> DataFrame:
    """(gram, h): the texts (key h) that hold each of the trigrams."""
    low = texts.select("h", _folded(F.col("text")).alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in trigrams])) if trigrams else F.array().cast("array<string>")
    return low.select("h", F.explode(held).alias("gram")).distinct()


def candidates(index: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """(h, kinds): by intersected postings, the rules whose trigrams a text holds; rules that scan fully aren't listed."""
    spark = index.sparkSession
    asked = [(kind, i, g, len(s)) for kind, q in queries.items() if q != EVERY for i, s in enumerate(sorted(map(sorted, q))) for g in s]
    wanted = F.broadcast(spark.createDataFrame(asked, "kind string, branch int, gram string, grams int"))  # a few rows a rule
    hits = index.join(wanted, "gram").groupBy("h", "kind", "branch", "grams").agg(F.count(F.lit(1)).alias("n")).filter("n = grams")
    return hits.groupBy("h").agg(F.collect_set("kind").alias("kinds"))


_MATCH = "array<struct<kind:int,i:int,gap:int,size:int,counts:boolean>>"


def _matches(rule: Rule, rank: int, text: Column, asked: Column) -> Column:
    """For each match in order: the rule, its number, characters since the last one, its characters, and whether it counts."""
    found = lambda group: F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(group))
    three = F.arrays_zip(found(0), F.split(text, rule.pattern, -1), found(rule.group)).cast("array<struct<own:string,gap:string,grp:string>>")
    each = F.transform(three, lambda x, i: F.struct(F.lit(rank), i, F.length(x["gap"]), F.length(x["own"]), F.length(x["grp"]) >= rule.least)).cast(_MATCH)
    return F.when(asked & text.rlike(rule.pattern), F.filter(each, lambda x: x["size"].isNotNull()))  # the last part ends the text


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, spans) per row of ``docs`` (doc_id, text): the array of (start, end, kind) of all rules' matches, in code
    points, end exclusive, by start and then in the order of the rules.

    A null or empty text has no spans. Repeated rows give one result each; a row without doc_id has its own. An empty table
    gives an empty one; other columns aren't read. A very long text is one row of one task, held a few times over; its
    matches are rows until the last step. Work and memory follow the texts and their matches.
    """
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    rank = {r.kind: i for i, r in enumerate(rules)}
    # rows with the same doc_id and text have the same spans; a chance agreement of h costs a needless check
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.withColumn("h", F.xxhash64("doc_id", "text"))
    grams = sorted(set().union(*(s for q in queries.values() for s in q)))
    found = candidates(scratch_table(trigram_index(texts, grams), "trigrams", narrow=True), queries)
    asked = texts.join(found, "h", "left")
    marker = F.array(F.struct(*[F.lit(None)] * 5)).cast(_MATCH)  # one row for the text itself
    held = lambda kind: F.lit(True) if queries[kind] == EVERY else F.coalesce(F.array_contains("kinds", kind), F.lit(False))
    every = [F.coalesce(_matches(r, rank[r.kind], F.col("text"), held(r.kind)), F.array().cast(_MATCH)) for r in rules]
    key = ["doc_id", "h", "g"]
    rows = asked.select("doc_id", "h", F.xxhash64(F.lit(1), "text").alias("g"), F.explode(F.concat(marker, *every)).alias("m")).select(*key, "m.*")
    # equal rows meet here: the marker counts them
    rows = rows.groupBy(*key, "kind", "i").agg(F.first("gap").alias("gap"), F.first("size").alias("size"), F.first("counts").alias("counts"), F.count(F.lit(1)).alias("copies"))
    line = W.partitionBy(*key, "kind").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap").cast("long") + F.col("size")).over(line))
    span = F.when(F.col("counts"), F.struct((F.col("end") - F.col("size")).alias("start"), "kind", "end"))
    out = rows.groupBy(*key).agg(F.max(F.when(F.col("kind").isNull(), F.col("copies"))).alias("copies"), F.array_sort(F.collect_list(span)).alias("own"))
    names = F.array(*[F.lit(r.kind) for r in rules])
    spans = F.transform("own", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), names[x["kind"]].alias("kind")))
    return out.select("doc_id", spans.alias("spans"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).drop("copy")


def op12_secrets(spark, sf_dir: str) -> DataFrame:
    found = scan(read_table(spark, sf_dir, "documents"))
    base = [r.kind for r in RULES if r.base]
    joined = lambda spans: F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in base],
                        F.sha2(joined(F.filter("spans", lambda x: x["kind"].isin(base))), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _oracle() -> str:
    """The same result with each rule run over every text."""
    either = lambda m: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in m[1])
    parts = []
    for i, r in enumerate(RULES):
        p = re.sub(r"\(\?i:([^)]*)\)", either, r.pattern).replace("'", "''")
        parts.append(f"SELECT rid, {i} AS k, '{r.kind}' AS kind, {r.least} AS least, regexp_extract_all(t, '{p}') AS own, "
                     f"regexp_extract_all(t, '{p}', {r.group}) AS grp, regexp_split_to_array(t, '{p}') AS gap FROM d WHERE regexp_matches(t, '{p}')")
    base = ", ".join(f"'{r.kind}'" for r in RULES if r.base)
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in RULES if r.base)
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
     m AS ({' UNION ALL '.join(parts)}),
     n AS (SELECT rid, k, kind, least, own, grp, gap, unnest(range(1, len(own) + 1)) AS i FROM m),
     s AS (SELECT rid, k, kind, coalesce(list_sum(list_transform(gap[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(own[1:i - 1], lambda x: length(x))), 0) AS a,
                  length(own[i]) AS size FROM n WHERE length(grp[i]) >= least),
     j AS (SELECT rid, k, kind, a, kind || ':' || a::BIGINT || ':' || (a + size)::BIGINT AS span FROM s),
     o AS (SELECT rid, {counts}, string_agg(span, ',' ORDER BY a, k) FILTER (kind IN ({base})) AS base, string_agg(span, ',' ORDER BY a, k) AS spans FROM j GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN o USING (rid)
"""


ORACLE = _oracle()
