"""Secret scans by an inverted index of trigrams, in DataFrame operations alone.

From each rule's pattern a Boolean query over trigrams is derived that every text with a match satisfies. The index
holds, for each trigram of any query, the documents with it; queries are answered by intersecting and uniting its
postings, and only documents that satisfy a rule's query are searched for that rule. Rules whose patterns imply no
trigram scan all documents.
"""

from __future__ import annotations

from re import _constants as C
from re import _parser as P

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from interfera.llm.spans import find, joined
from interfera.llm.store import checkpoint, small, table

#: The rules of the contract, then ours; name, pattern, and a pattern that a match must then satisfy.
BASE = [
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", None),
    ("access", r"AKIA[A-Z0-9]+", r"^.{20,}$"),
    ("hex", r"[0-9a-f]{24,}", None),
]
MORE = [
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", None),
    ("slack", r"xox[baprs]-[A-Za-z0-9-]{10,}", None),
    ("google", r"AIza[0-9A-Za-z_-]{35}", None),
    ("stripe", r"[rs]k_live_[0-9a-zA-Z]{16,}", None),
    ("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", None),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", None),
    ("bearer", r"(?i:authorization)\x20*:\x20*(?i:bearer)\x20+[A-Za-z0-9._~+/=-]{16,}", None),
    ("login", r"://[A-Za-z0-9._~%-]+:[^\s:/@]+@", None),
]
RULES = BASE + MORE

Query = tuple | bool  # ("and" | "or", queries...), ("has", trigram), or True: any text
_MOST = 64


def _both(queries: list[Query]) -> Query:
    queries = list(dict.fromkeys(q for q in queries if q is not True))
    return True if not queries else queries[0] if len(queries) == 1 else ("and", *queries)


def _either(queries: list[Query]) -> Query:
    queries = list(dict.fromkeys(queries))
    return True if True in queries else queries[0] if len(queries) == 1 else ("or", *queries)


def _of(strings: set[str]) -> Query:
    """Texts that have one of the strings; a string that holds another one asks for nothing new."""
    least = [s for s in sorted(strings) if not any(t != s and t in s for t in strings)]
    return _either([_both([("has", s[i : i + 3]) for i in range(len(s) - 2)]) for s in least])


def _strings(op, arg) -> set[str] | None:
    """All strings that the node matches, in lower case, if they are few."""
    if op is C.LITERAL:
        return {chr(arg).lower()}
    if op is C.IN:
        out: set[str] = set()
        for kind, x in arg:
            if kind is C.LITERAL:
                out.add(chr(x).lower())
            elif kind is C.RANGE and x[1] - x[0] < 8:
                out |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None
        return out if len(out) <= 8 else None
    if op is C.BRANCH:
        parts = [_sequence(x) for x in arg[1]]
        return None if any(p is None for p in parts) else set().union(*parts)
    if op is C.SUBPATTERN:
        return _sequence(arg[-1])
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
        low, high, body = arg
        inner = _sequence(body) if high <= 2 else None
        if inner is None:
            return None
        out, power = set(), {""}
        for n in range(high + 1):
            out |= power if n >= low else set()
            power = {a + b for a in power for b in inner}
        return out if len(out) <= _MOST else None
    return {""} if op in (C.AT, C.ASSERT, C.ASSERT_NOT) else None


def _sequence(nodes) -> set[str] | None:
    out = {""}
    for op, arg in nodes:
        if (s := _strings(op, arg)) is None or len(out) * len(s) > _MOST:
            return None
        out = {a + b for a in out for b in s}
    return out


def _implied(nodes) -> Query:
    said, now = [], {""}
    for op, arg in nodes:
        s = _strings(op, arg)
        if s is not None and len(now) * len(s) <= _MOST:
            now = {a + b for a in now for b in s}
            continue
        said.append(_of(now))
        now = {""}
        if s is not None:
            now = s
        elif op is C.SUBPATTERN:
            said.append(_implied(arg[-1]))
        elif op is C.BRANCH:
            said.append(_either([_implied(x) for x in arg[1]]))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and arg[0] >= 1:
            said.append(_implied(arg[2]))
    return _both([*said, _of(now)])


def trigram_query(pattern: str) -> Query:
    """What the lower-cased text must hold for the pattern to match; True if that can't be said in trigrams."""
    return _implied(P.parse(pattern))


def trigrams(query: Query) -> set[str]:
    return set() if query is True else {query[1]} if query[0] == "has" else set().union(*(trigrams(q) for q in query[1:]))


_BITS = 62


def _has(at: int) -> Column:
    """Whether the document has trigram number ``at``, by the bits that ``answer`` gathers."""
    return F.col(f"bits{at // _BITS}").bitwiseAND(F.lit(1 << at % _BITS)) != 0


def _holds(query: Query, number: dict[str, int]) -> Column:
    if query is True:
        return F.lit(True)
    if query[0] == "has":
        return _has(number[query[1]])
    out = None
    for q in query[1:]:
        x = _holds(q, number)
        out = x if out is None else (out & x) if query[0] == "and" else (out | x)
    return out


def postings(docs: DataFrame, wanted: list[str], key: str, text: str) -> DataFrame:
    """The index: a row (trigram's number in ``wanted``, key) for each document that has the trigram in lower case."""
    all_ = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(g).alias("g")) for i, g in enumerate(wanted)])
    low = docs.select(F.col(key).alias("k"), F.lower(F.col(text)).alias("low"))
    return low.select("k", F.explode(F.filter(all_, lambda g: F.contains(F.col("low"), g["g"]))).alias("x")).select(F.col("x.i").alias("i"), "k")


def answer(index: DataFrame, queries: list[Query], wanted: list[str]) -> DataFrame:
    """k and ``rules``, the bits of the queries that it satisfies, of documents with any.

    All posting lists are merged by document at once, as a bit for each trigram, which intersects and unites them in
    one pass; no list is in one task.
    """
    words = range(-(-len(wanted) // _BITS))
    found = index.groupBy("k").agg(*[F.bit_or(_shifted(w)).alias(f"bits{w}") for w in words])
    number = {g: i for i, g in enumerate(wanted)}
    rules = F.lit(0)
    for i, q in enumerate(queries):
        if q is not True:
            rules = rules.bitwiseOR(F.when(_holds(q, number), F.lit(1 << i)).otherwise(F.lit(0)))
    return found.select("k", rules.cast("int").alias("rules")).filter("rules <> 0")


def _shifted(word: int) -> Column:
    """The bit of a trigram in its word; 0 in others."""
    return F.expr(f"CASE WHEN i div {_BITS} = {word} THEN shiftleft(1L, cast(i % {_BITS} AS int)) ELSE 0L END")


def scan(docs: DataFrame, rules: list[tuple[str, str, str | None]] = RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Returns key, text (null: empty) and a column of spans (s, e, m) for each rule.

    Keys may repeat or be null: their rows share postings, each row is searched by itself and stays. Texts of any
    length are searched whole; an empty table gives none; other columns are ignored, whatever their names.
    """
    queries = [trigram_query(pattern) for _, pattern, _ in rules]
    rows = docs.select(F.col(key).alias("k_"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t_"))
    wanted = sorted(set().union(*map(trigrams, queries)))
    if wanted:
        candidates = checkpoint(answer(postings(rows, wanted, "k_", "t_"), queries, wanted))
        rows = rows.join(small(candidates, candidates.count()), rows["k_"].eqNullSafe(candidates["k"]), "left").drop("k")

    def long_value(pattern: str):
        return lambda x: F.length(F.regexp_extract(x["m"], pattern, 1)) >= 6

    def satisfies(pattern: str):
        return lambda x: x["m"].rlike(pattern)

    for i, (name, pattern, then) in enumerate(rules):
        rows = find(rows, "t_", name, pattern, None if queries[i] is True else F.col("rules").bitwiseAND(F.lit(1 << i)) != 0)
        if name == "assign":
            rows = rows.withColumn(name, F.filter(name, long_value(pattern)))
        elif then:
            rows = rows.withColumn(name, F.filter(name, satisfies(then)))
    return rows.select(F.col("k_").alias(key), F.col("t_").alias(text), *[n for n, _, _ in rules])


def op6_trigram_secrets(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    count = lambda n: F.size(n).cast("long").alias(f"n_{n}")
    base = joined([(n, F.col(n)) for n, _, _ in BASE])
    return found.select("doc_id", *[count(n) for n, _, _ in BASE], F.sha2(base.cast("binary"), 256).alias("base_sha256"), joined([(n, F.col(n)) for n, _, _ in RULES]).alias("spans"))
