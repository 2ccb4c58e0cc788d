"""Secret scanning with a trigram inverted index, in DataFrame functions only.

Each rule's regular expression gives a Boolean query over trigrams: alternatives of sets that a match must
hold. The index has a posting (trigram, document) for every trigram that some query asks for. A rule's
candidates are the documents whose postings fill one of its alternatives; only these are matched by the
rule's expression. A rule without mandatory trigrams scans all documents. The index decides nothing but
where to look: spans come from the expressions over the whole text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corrobora.llm.common import BROADCAST_ROWS, text_or_empty, written

_parser = re._parser
_c = re._constants
#: Strings that an expression's exact part may have before its trigrams are taken.
MOST_STRINGS = 64
#: Trigrams asked for by an alternative, those with fewest letters first, as they are rarest in prose. Fewer only
#: let more candidates through.
MOST_TRIGRAMS = 3


@dataclass(frozen=True)
class Rule:
    """kind, expression, which of its groups must be how long (0: the whole match), and whether it is a base rule."""

    kind: str
    pattern: str
    group: int
    least: int
    base: bool = True
    quick: str = ""  # an expression that every kept match contains, to pass over texts without one
    query: list[frozenset[str]] = field(default_factory=list, compare=False)


#: The base expressions with their least lengths, then what is searched besides.
RULES = [
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"""AKIA[A-Z0-9]+""", 0, 20, quick=r"AKIA[A-Z0-9]{16}"),
    Rule("hex", r"""[0-9a-f]+""", 0, 24, quick=r"[0-9a-f]{24}"),
    Rule("pem", r"""-----BEGIN [A-Z ]*PRIVATE KEY-----""", 0, 0, base=False),
    Rule("github", r"""gh[opsu]_[A-Za-z0-9]{36}""", 0, 0, base=False),
    Rule("github_fine", r"""github_pat_[A-Za-z0-9_]{82}""", 0, 0, base=False),
    Rule("gitlab", r"""glpat-[A-Za-z0-9_-]{20}""", 0, 0, base=False),
    Rule("slack", r"""xox[abprs]-[A-Za-z0-9-]{10,}""", 0, 0, base=False),
    Rule("slack_hook", r"""hooks\.slack\.com/services/T[A-Z0-9]{8,12}/B[A-Z0-9]{8,12}/[A-Za-z0-9]{24}""", 0, 0, base=False),
    Rule("stripe", r"""[rs]k_live_[A-Za-z0-9]{24,}""", 0, 0, base=False),
    Rule("google", r"""AIza[A-Za-z0-9_-]{35}""", 0, 0, base=False),
    Rule("google_oauth", r"""ya29\.[A-Za-z0-9_-]{20,}""", 0, 0, base=False),
    Rule("access_temporary", r"""ASIA[A-Z0-9]{16}""", 0, 0, base=False),
    Rule("npm", r"""npm_[A-Za-z0-9]{36}""", 0, 0, base=False),
    Rule("pypi", r"""pypi-AgEIcHlwaS5vcmc[A-Za-z0-9_-]{50,}""", 0, 0, base=False),
    Rule("sendgrid", r"""SG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43}""", 0, 0, base=False),
    Rule("shopify", r"""shp(?:at|ca|pa|ss)_[0-9a-fA-F]{32}""", 0, 0, base=False),
    Rule("digitalocean", r"""do[opr]_v1_[0-9a-f]{64}""", 0, 0, base=False),
    Rule("databricks", r"""dapi[0-9a-f]{32}""", 0, 0, base=False),
    Rule("docker", r"""dckr_pat_[A-Za-z0-9_-]{27}""", 0, 0, base=False),
    Rule("azure_storage", r"""AccountKey=[A-Za-z0-9+/]{86}==""", 0, 0, base=False),
    Rule("telegram", r"""[0-9]{8,10}:AA[A-Za-z0-9_-]{33}""", 0, 0, base=False),
    Rule("age", r"""AGE-SECRET-KEY-1[A-Z0-9]{58}""", 0, 0, base=False),
]


def trigrams(strings: set[str]) -> list[frozenset[str]]:
    """Alternatives of trigram sets of which any of the strings fills one; none if a string is too short."""
    sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
    if frozenset() in sets:
        return []
    return sorted((s for s in sets if not any(t < s for t in sets)), key=sorted)


def _both(x: list[frozenset[str]], y: list[frozenset[str]]) -> list[frozenset[str]]:
    if not x or not y:
        return x or y
    joined = {a | b for a, b in product(x, y)}
    return sorted((s for s in joined if not any(t < s for t in joined)), key=sorted)


def query_of(pattern: str) -> list[frozenset[str]]:
    """The expression's trigram query in lower case: an empty list asks for nothing."""

    def walk(items) -> tuple[set[str] | None, list[frozenset[str]]]:
        """The strings a part matches, if few, and otherwise what its matches must hold."""
        exact: set[str] | None = {""}
        asked: list[frozenset[str]] = []
        whole = True
        for op, value in items:
            strings, query = part(op, value)
            if strings is not None and len(exact) * len(strings) <= MOST_STRINGS:
                exact = {a + b for a, b in product(exact, strings)}
                continue
            whole = False
            asked = _both(asked, trigrams(exact))
            if strings is not None:
                exact = strings
            else:
                asked, exact = _both(asked, query), {""}
        return (exact, []) if whole else (None, _both(asked, trigrams(exact)))

    def part(op, value) -> tuple[set[str] | None, list[frozenset[str]]]:
        if op is _c.LITERAL:
            return {chr(value).lower()}, []
        if op is _c.IN:
            points = [p for kind, v in value for p in ([v] if kind is _c.LITERAL else range(v[0], v[1] + 1) if kind is _c.RANGE else range(99))]
            return ({chr(p).lower() for p in points}, []) if len(points) <= 4 and value[0][0] is not _c.NEGATE else (None, [])
        if op is _c.SUBPATTERN:
            return walk(value[3])
        if op is _c.BRANCH:
            found = [walk(b) for b in value[1]]
            if all(s is not None for s, _ in found):
                return set().union(*(s for s, _ in found)), []
            each = [trigrams(s) if s is not None else q for s, q in found]
            return None, sorted({s for q in each for s in q}, key=sorted) if all(each) else []
        if op in (_c.MAX_REPEAT, _c.MIN_REPEAT):
            low, high, inner = value
            strings, query = walk(inner)
            if strings is not None and high == 1:
                return strings | ({""} if low == 0 else set()), []
            if low == 0:
                return None, []
            return None, trigrams(strings) if strings is not None else query
        return None, []

    strings, query = walk(_parser.parse(pattern))
    return trigrams(strings) if strings is not None else query


def lookups(rule: Rule) -> list[frozenset[str]]:
    """The rule's query with at most MOST_TRIGRAMS trigrams an alternative, which its matches must hold as well."""
    few = {frozenset(sorted(s, key=lambda t: (sum(map(str.isalpha, t)), t))[:MOST_TRIGRAMS]) for s in query_of(rule.pattern)}
    return sorted((s for s in few if not any(t < s for t in few)), key=sorted)


def index(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """Postings (trigram, doc_id) of the trigrams that the rules' queries ask for, in lower-case text."""
    asked = sorted({t for r in rules for s in lookups(r) for t in s})
    low = docs.select("doc_id", F.lower("text").alias("low"))
    present = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in asked))) if asked else F.array().cast("array<string>")
    return low.select("doc_id", F.explode(present).alias("trigram"))


def candidates(postings: DataFrame, rules: list[Rule]) -> DataFrame:
    """(doc_id, kinds): documents that fill an alternative of a rule's query, with those rules' kinds."""
    rows = [(r.kind, k, len(s), t) for r in rules for k, s in enumerate(lookups(r)) for t in sorted(s)]
    asked = postings.sparkSession.createDataFrame(rows, "kind string, alternative int, size int, trigram string")
    found = postings.distinct().join(F.broadcast(asked), "trigram")  # as many rows as the rules have trigrams
    filled = found.groupBy("doc_id", "kind", "alternative", "size").agg(F.count("*").alias("n")).where("n = size")
    return filled.groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))


STEP = 256


def running(lengths: Column) -> Column:
    """Running sums of an array of integers, each including its own element, in two levels of STEP."""

    def sums(values: Column) -> Column:
        zero = F.struct(F.lit(0).alias("total"), F.array().cast("array<int>").alias("ends"))
        return F.aggregate(
            values,
            zero,
            lambda acc, x: F.struct((acc["total"] + x).alias("total"), F.concat(acc["ends"], F.array(acc["total"] + x)).alias("ends")),
            lambda acc: acc["ends"],
        )

    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / STEP).cast("int")), lambda k: sums(F.slice(lengths, k * STEP + 1, STEP)))
    before = lambda p: F.concat(F.array(F.lit(0)), sums(F.transform(p, lambda x: F.element_at(x, -1))))
    return F.flatten(F.zip_with(parts, F.slice(before(parts), 1, F.size(parts)), lambda part, base: F.transform(part, lambda x: x + base)))


SPAN = "array<struct<start:int,rank:int,kind:string,end:int>>"


def spans(text: Column, rule: Rule, rank: int) -> Column:
    """The rule's kept matches, leftmost and non-overlapping, as (start, rank, kind, end) in code points."""
    # Every piece is what stands before a match and the match; the last one ends the text without a match.
    piece = rf"([\s\S]*?)({rule.pattern}|\z)"
    gaps = F.transform(F.regexp_extract_all(text, F.lit(piece), F.lit(1)), F.length)
    whole = F.transform(F.regexp_extract_all(text, F.lit(piece), F.lit(2)), F.length)
    judged = F.transform(F.regexp_extract_all(text, F.lit(piece), F.lit(2 + rule.group)), F.length) if rule.group else whole
    ends = running(F.zip_with(gaps, whole, lambda a, b: a + b))
    rows = F.arrays_zip(ends.alias("end"), whole.alias("n"), judged.alias("judged"))
    kept = F.filter(rows, lambda x: (x["n"] > 0) & (x["judged"] >= rule.least))
    return F.transform(kept, lambda x: F.struct((x["end"] - x["n"]).alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), x["end"].alias("end"))).cast(SPAN)


def scan(docs: DataFrame, rules: list[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, found): every document's spans of all rules, by start and then by the rules' order.

    Offsets count code points, end exclusive. A rule's matches are leftmost and do not overlap each other;
    those of different rules may. A null text counts as empty. Null and repeated identifiers are kept as they
    come, other columns are ignored, an empty table gives no rows.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    flagged = written(candidates(index(source, rules), rules))
    few = flagged.count() <= BROADCAST_ROWS
    hit = flagged.withColumnRenamed("doc_id", "hit")
    rows = source.join(F.broadcast(hit) if few else hit, F.col("doc_id").eqNullSafe(F.col("hit")), "left")
    none = F.array().cast(SPAN)
    found = []
    for rank, rule in enumerate(rules):
        look = F.array_contains("kinds", rule.kind) if query_of(rule.pattern) else F.lit(True)
        if rule.quick:
            look = look & F.col("text").rlike(rule.quick)
        found.append(F.when(look, spans(F.col("text"), rule, rank)).otherwise(none))
    return rows.select("doc_id", F.array_sort(F.concat(*found)).alias("found"))


def digests(docs: DataFrame, rules: list[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, one count n_<kind> per base rule, base_sha256 of the base spans, and spans, all of them."""
    found = scan(docs, rules, id_col, text_col)
    base = [r for r in rules if r.base]
    line = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    of = lambda kind: lambda x: x["kind"] == kind
    joined = lambda c: F.array_join(F.transform(c, line), ",")
    return found.select(
        "doc_id",
        *(F.size(F.filter("found", of(r.kind))).cast("long").alias(f"n_{r.kind}") for r in base),
        F.sha2(joined(F.filter("found", lambda x: x["rank"] < len(base))), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
    )


def oracle(rules: list[Rule] = RULES) -> str:
    """The same for DuckDB, by the expressions alone."""
    lists = []
    for rank, r in enumerate(rules):
        piece = rf"([\s\S]*?)({r.pattern}|\z)".replace("'", "''")
        held = f"CASE WHEN regexp_matches(t, '{r.pattern.replace(chr(39), chr(39) * 2)}') THEN t ELSE '' END"
        get = lambda g, p=piece, t=held: f"list_transform(regexp_extract_all({t}, '{p}', {g}), lambda x: length(x))"
        lists.append(f"""
            (SELECT list({{'start': e - n, 'rank': {rank}, 'kind': '{r.kind}', 'end': e}}) FROM (
                SELECT n, j, sum(g + n) OVER (ORDER BY i) AS e FROM (SELECT unnest({get(1)}) AS g, unnest({get(2)}) AS n, unnest({get(2 + r.group)}) AS j, generate_subscripts({get(1)}, 1) AS i)
            ) WHERE n > 0 AND j >= {r.least})""")
    n = sum(r.base for r in rules)
    return f"""
        WITH s AS (
            SELECT doc_id, list_sort(list_concat({', '.join(f"coalesce({x}, [])" for x in lists)})) AS f
            FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
        )
        SELECT doc_id, {', '.join(f"len(list_filter(f, lambda x: x.kind = '{r.kind}')) AS n_{r.kind}" for r in rules if r.base)},
               sha256(array_to_string(list_transform(list_filter(f, lambda x: x.rank < {n}), lambda x: concat(x.kind, ':', x.start::BIGINT, ':', x."end"::BIGINT)), ',')) AS base_sha256,
               array_to_string(list_transform(f, lambda x: concat(x.kind, ':', x.start::BIGINT, ':', x."end"::BIGINT)), ',') AS spans
        FROM s
    """
