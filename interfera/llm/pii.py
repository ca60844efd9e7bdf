"""Personal data by candidate gradient boosting, in DataFrame operations alone.

Generators propose spans, generously and with overlaps. Each proposal becomes a number whose bits say how it is
written, what stands around it, and whether it passes its kind's check (a checksum, a range, a number of digits).

Boosted trees of depth two over these bits learn which proposals are personal data, from more than the strict rules
say. Confirmed spans are good, and so are disguises of them: each is written anew in ways that the rules reject
(``(at)`` and ``dot``, spaced or bracketed addresses, cards in dotted groups, phones without their plus), in its own
context. Proposals as they stand that no rule confirms are bad, and so are spoilt copies of confirmed spans. On
documents that weren't fitted, each kind gets the lowest threshold at which its proposals are good often enough; what
scores above it is selected beside the base spans.

All proposals count: they're aggregated to a row for each number, so what the driver fits is bounded by the bits. Time
grows with the text: contexts come with the matches, and spans are sorted once and swept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from interfera.llm.spans import cut, find, joined, let, maxima, parts, starts
from interfera.llm.store import checkpoint, table

KINDS = ["email", "ip", "card", "phone"]
_LOCAL = "[A-Za-z0-9._%+-]"
#: The contract's patterns, in possessive form, and a cheap condition that every text with a match satisfies.
STRICT = {
    "email": (rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", "."),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", None),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
}
#: Generous patterns of ours.
LOOSE = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}{{1,64}}+(?:@|\x20?[\[(]\x20?at\x20?[\])]\x20?|\x20at\x20)[A-Za-z0-9-]{{1,63}}+(?:(?:\.|\x20?[\[(]\x20?dot\x20?[\])]\x20?|\x20dot\x20)[A-Za-z0-9-]{{1,63}}+){{1,8}}+",
    "ip": r"(?<![0-9])[0-9]{1,4}(?:\x20?[.\[\]]{1,3}\x20?[0-9]{1,4}){3,7}+(?![0-9])",
    "card": r"[0-9](?:[\x20./-]{0,2}[0-9])++",
    "phone": r"(?<![0-9A-Za-z])(?:\+|00)?[0-9]{0,3}[\x20./-]?\(?[0-9]{2,4}\)?[\x20./-][0-9]{3,4}[\x20./-]?[0-9]{3,4}(?![0-9])",
}
#: What every text with a match of the generous pattern has.
_HAS = {"email": r"@|[\x20\[(]at[\x20\])]", "ip": "[0-9]", "card": "[0-9]", "phone": "[0-9]"}
_OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"
_CONTEXT = 32
PRECISION = 0.995
TREES, RATE, RIDGE = 24, 0.3, 1.0
#: Confirmed proposals of a kind that calibration asks for, to select any others of that kind.
ENOUGH = 20


def _digits(m: Column) -> Column:
    """Only kinds other than addresses of mail have them asked; these hold nothing else but what is taken out."""
    return F.translate(m, " \t\n\r\f\v+-./()[]", "")


def _luhn(m: Column) -> Column:
    def holds(d: Column) -> Column:
        value = lambda i: F.ascii(F.substring(d, i, F.lit(1))) - 48
        twice = lambda v: v * 2 - F.when(v > 4, 9).otherwise(0)
        each = lambda a, i: a + F.when(i % 2 == 0, twice(value(i))).otherwise(value(i))
        total = F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), each)
        return F.when(F.length(d).between(12, 19), total % 10 == 0).otherwise(False)

    return let(F.reverse(_digits(m)), holds)


def _confirmed(kind: str, m: Column) -> Column:
    if kind == "email":
        return m.rlike(rf"^{_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++$")
    if kind == "ip":
        return m.rlike(_OCTETS)
    if kind == "card":
        return _luhn(m)
    return m.startswith("+") & F.length(_digits(m)).between(9, 15)


def _before(b: Column) -> Column:
    """Bits of what is before a span: it ends in white space or is empty, has words that go with personal data, or words
    that go with other numbers."""
    def bits(low: Column) -> Column:
        last = F.right(low, F.lit(1))
        words = low.rlike("mail|phone|tel|call|fax|contact|card|visa|credit|addr|host|server")
        others = low.rlike(r"version|release|order|isbn|page|section|v\.?\s*$")
        return sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(((last == "") | last.rlike(r"\s"), words, others))), F.lit(0))

    return let(F.lower(b), bits)


def _bits(kind: int, x: Column) -> list[Column]:
    """How a span (see ``_seen``) is written and what stands around it."""
    m, n = x["m"], x["d"]
    no = F.lit(False)
    if KINDS[kind] == "card":  # digits, and what parts them
        written = [no, x["n"] > n, F.left(m, F.lit(1)).isin("3", "4", "5", "6"), F.contains(m, F.lit("555"))]
    else:
        written = [m.rlike(r"[()\[\]]"), m.rlike(r"[\x20-]"), m.rlike(r"^[+3-6]"), m.rlike(r"555|(?:com|org|net|edu|example)$")]
    context = lambda i: x["b"].bitwiseAND(F.lit(1 << i)) != 0
    return [
        F.lit(kind % 2 == 1), F.lit(kind >= 2), x["n"] > 14, x["n"] > 18, n >= 10, n >= 13, n >= 16, *written,
        context(0), (x["a"] == "") | x["a"].rlike(r"[\s.,;!?)]"), context(1), context(2),
        m.rlike(r"\x20(?:at|dot)\x20|[\[(]") if kind < 2 else no, x["ok"],
    ]


def _seen(kind: str, m: Column, n: Column, b: Column, a: Column) -> Column:
    """What bits are read from: the span m, its length n and number of digits d, whether its kind's check holds, the bits
    of what is before it, and the code point after it."""
    digits = F.lit(0) if kind == "email" else F.length(_digits(m))
    return F.struct(m.alias("m"), n.alias("n"), digits.alias("d"), F.coalesce(_confirmed(kind, m), F.lit(False)).alias("ok"), b.alias("b"), a.alias("a"))


BITS = 17


def _number(kind: int, x: Column) -> Column:
    out = F.lit(0)
    for i, b in enumerate(_bits(kind, x)):
        out = out + F.when(b, 1 << i).otherwise(0)
    return out


def _disguised(kind: str, m: Column) -> list[tuple[Column, int]]:
    """Ways to write a confirmed span that its rule rejects (1), and copies that aren't personal data (0)."""
    if kind == "email":
        local, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
        wordy = lambda at, dot: F.concat(local, F.lit(at), F.replace(domain, F.lit("."), F.lit(dot)))
        return [(wordy(" (at) ", "."), 1), (wordy(" at ", " dot "), 1), (wordy("[at]", "[dot]"), 1)]
    if kind == "ip":
        return [(F.replace(m, F.lit("."), F.lit(d)), 1) for d in (" . ", "[.]")] + [(F.regexp_replace(m, "^[0-9]+", "999"), 0)]
    if kind == "card":
        d = _digits(m)
        grouped = lambda by: F.regexp_replace(d, "([0-9]{4})(?=[0-9])", f"$1{by}")
        wrong = F.concat(F.substring(d, F.lit(1), F.length(d) - 1), ((F.right(d, F.lit(1)).cast("int") + 1) % 10).cast("string"))
        return [(grouped("."), 1), (grouped("/"), 1), (wrong, 0)]
    bare = F.replace(m, F.lit("+"), F.lit(""))
    return [(bare, 1), (F.regexp_replace(F.regexp_replace(bare, "[^0-9]+", "."), r"^\.|\.$", ""), 1), (F.left(bare, F.lit(8)), 0)]


def _taught(i: int, kind: str) -> Column:
    """k, x and y of the confirmed spans of a kind, their disguises and spoilt copies."""
    def of(v: Column, m: Column, y: int) -> Column:
        return let(_seen(kind, m, F.length(m), _before(v["b"]), v["a"]), lambda w: F.struct(F.lit(i).alias("k"), _number(i, w).alias("x"), F.lit(y).alias("y")))

    return F.flatten(F.transform(kind, lambda v: F.array(*[of(v, m, y) for m, y in [(v["m"], 1), *_disguised(kind, v["m"])]])))


def propose(rows: DataFrame) -> DataFrame:
    """rows: k and t (not null), and any others. Adds a column of confirmed spans for each kind; ``more``, the proposals
    as k (kind), s, e, x (number), y (confirmed, 0 or 1), without those that overlap a base span; and ``taught``, what to learn
    from beside them."""
    for kind, (pattern, has) in STRICT.items():
        rows = find(rows, "t", kind, pattern, F.col("t").rlike("[0-9]") if has is None else F.contains("t", F.lit(has)), _CONTEXT)
        rows = rows.withColumn(kind, F.filter(kind, _keeps(kind)))
    for kind in KINDS:
        rows = find(rows, "t", f"loose_{kind}", LOOSE[kind], F.col("t").rlike(_HAS[kind]), _CONTEXT)
    rows = rows.withColumn("loose_card", F.flatten(F.transform("loose_card", _alternatives)))
    made = F.concat(*[F.transform(f"loose_{k}", _proposal(i, k)) for i, k in enumerate(KINDS)])
    base = F.concat(*[F.transform(k, lambda b: F.struct(b["s"].alias("s"), F.lit(0).alias("own"), b["e"].alias("e"), F.lit(0).alias("k"), F.lit(0).alias("x"), F.lit(0).alias("y"))) for k in KINDS])

    def outside(every: Column) -> Column:
        """Of base spans (own 0) and proposals (own 1) in order, the proposals that overlap no base span."""
        is_base = lambda v: v["own"] == 0
        ends = F.transform(every, lambda v: F.when(is_base(v), v["e"]).otherwise(0))
        # from the right, how far each base span's start is from the largest number, so that the next start is the most
        starts_ = F.transform(F.reverse(every), lambda v: F.when(is_base(v), F.lit(_LAST) - v["s"]).otherwise(0))
        free = lambda top, next_: F.filter(every, lambda v, i: (v["own"] == 1) & (v["s"] >= F.get(top, i)) & (v["e"] <= F.lit(_LAST) - F.get(next_, F.size(every) - 1 - i)))
        return let(maxima(ends), lambda top: let(maxima(starts_), lambda next_: free(top, next_)))

    some = sum((F.size(f"loose_{k}") for k in KINDS), F.lit(0))
    rows = rows.withColumn("more", F.when(some > 0, let(F.array_sort(F.concat(base, made)), outside)).otherwise(F.array().cast(_MORE)))
    rows = rows.withColumn("taught", F.concat(*[_taught(i, k) for i, k in enumerate(KINDS)]))
    for kind in KINDS:
        rows = rows.withColumn(kind, F.transform(kind, lambda b: F.struct(b["s"].alias("s"), b["e"].alias("e"), b["m"].alias("m"))))
    return rows.drop(*[f"loose_{k}" for k in KINDS])


_LAST = (1 << 31) - 1
_WITH_BITS = "array<struct<s:int,e:int,m:string,b:int,a:string>>"
_MORE = "array<struct<s:int,own:int,e:int,k:int,x:int,y:int>>"


def _alternatives(x: Column) -> Column:
    """Of a run of numbers, every span of 12 to 19 digits from the start of a number to the end of one; their strings have
    a space for whatever parts the numbers, and b is ``_before``."""
    numbers, gaps = F.regexp_extract_all(x["m"], F.lit("([0-9]+)"), F.lit(1)), F.split(x["m"], "[0-9]+", -1)

    def placed(d: Column, g: Column) -> Column:
        n, w = F.transform(d, F.length), F.transform(d, lambda v, i: F.length(v) + F.length(F.get(g, i)))
        at = lambda b, p: F.transform(d, lambda v, i: F.struct((F.get(p, i) + F.length(F.get(g, i))).alias("s"), (F.get(p, i) + F.length(F.get(g, i)) + F.length(v)).alias("e"), F.get(b, i).alias("b"), (F.get(b, i) + F.length(v)).alias("n"), i.alias("i")))
        return let(starts(n), lambda b: let(starts(w), lambda p: at(b, p)))

    def spans(d: Column, g: Column, every: Column) -> Column:
        def ends(p: Column, i: Column) -> Column:
            some = F.filter(F.slice(every, i + 1, F.lit(19)), lambda q: (q["n"] - p["b"]).between(12, 19))
            before = F.when(i == 0, x["b"]).otherwise(F.concat(F.get(d, i - 1), F.get(g, i)))
            after = lambda q: F.when(q["i"] + 1 == F.size(d), x["a"]).otherwise(F.left(F.get(g, q["i"] + 1), F.lit(1)))
            made = lambda bits: F.transform(some, lambda q: F.struct((x["s"] + p["s"]).alias("s"), (x["s"] + q["e"]).alias("e"), F.array_join(F.slice(d, i + 1, q["i"] - i + 1), " ").alias("m"), bits.alias("b"), after(q).alias("a")))
            return F.when(F.get(every, i + F.least(F.lit(18), F.size(every) - i - 1))["n"] - p["b"] >= 12, let(_before(before), made)).otherwise(F.array().cast(_WITH_BITS))

        return F.flatten(F.transform(every, ends))

    found = let(numbers, lambda d: let(gaps, lambda g: let(placed(d, g), lambda every: spans(d, g, every))))
    return F.when(F.length(F.regexp_replace(x["m"], "[^0-9]", "")) >= 12, found).otherwise(F.array().cast(_WITH_BITS))


def _keeps(kind: str):
    return lambda x: _confirmed(kind, x["m"])


def _proposal(i: int, kind: str):
    def one(x: Column) -> Column:
        seen = _seen(kind, x["m"], x["e"] - x["s"], x["b"] if kind == "card" else _before(x["b"]), x["a"])
        return let(seen, lambda w: F.struct(x["s"].alias("s"), F.lit(1).alias("own"), x["e"].alias("e"), F.lit(i).alias("k"), _number(i, w).alias("x"), w["ok"].cast("int").alias("y")))

    return one


Tree = tuple[int, tuple[int, float, float], tuple[int, float, float]]  # bit; then for 0 and 1: bit, value at 0, at 1


def boost(counts: list[tuple[int, int, int]]) -> tuple[float, list[Tree]]:
    """Logistic boosting by Newton steps. counts: number, proposals, confirmed ones."""
    total, good = sum(c[1] for c in counts), sum(c[2] for c in counts)
    if not total or good in (0, total):
        return (-9.0 if not good else 9.0), []
    bias = math.log(good / (total - good))
    score, trees = [bias] * len(counts), []

    def leaf(rows: list[int]) -> tuple[float, float]:
        """The value of a leaf, and what it gains."""
        g = h = 0.0
        for r in rows:
            p = 1 / (1 + math.exp(-score[r]))
            g += counts[r][2] - counts[r][1] * p
            h += counts[r][1] * p * (1 - p)
        return g / (h + RIDGE), g * g / (h + RIDGE)

    def split(rows: list[int], bit: int) -> tuple[list[int], list[int]]:
        return [r for r in rows if not counts[r][0] >> bit & 1], [r for r in rows if counts[r][0] >> bit & 1]

    def stump(rows: list[int]) -> tuple[float, tuple[int, float, float]]:
        best = (-1.0, (0, 0.0, 0.0))
        for bit in range(BITS):
            (a, ga), (b, gb) = (leaf(x) for x in split(rows, bit))
            best = max(best, (ga + gb, (bit, a, b)))
        return best

    every = list(range(len(counts)))
    for _ in range(TREES):
        tops = sorted(((sum(leaf(x)[1] for x in split(every, b)), b) for b in range(BITS)), reverse=True)[:4]
        gain, tree = max((sum(s[0] for s in both), (b, both[0][1], both[1][1])) for _, b in tops for both in [[stump(x) for x in split(every, b)]])
        if gain < 1e-6:
            break
        b, *sides = tree
        tree = (b, *[(c, RATE * u, RATE * v) for c, u, v in sides])
        trees.append(tree)
        for r in every:
            score[r] += _value(tree, counts[r][0])
    return bias, trees


def _value(tree: Tree, x: int) -> float:
    bit, u, v = tree[1 + (x >> tree[0] & 1)]
    return v if x >> bit & 1 else u


def learn(proposed: DataFrame) -> tuple[float, list[Tree], list[float]]:
    """The bias, the trees, and each kind's threshold on the sum."""
    part = F.pmod(F.xxhash64(F.coalesce(F.col("k").cast("string"), F.lit(""))), F.lit(5)) == 0
    every = F.concat(F.transform("more", lambda p: F.struct(p["k"].alias("k"), p["x"].alias("x"), p["y"].alias("y"))), "taught")
    each = proposed.select(part.alias("held"), F.explode(every).alias("p")).groupBy("held", "p.k", "p.x").agg(F.count(F.lit(1)).alias("n"), F.sum("p.y").alias("y"))
    rows = sorted(tuple(r) for r in each.collect())  # 2 ** (BITS + 1) rows at most
    bias, trees = boost([(x, n, y) for held, _, x, n, y in rows if not held])
    limits = []
    for kind in range(len(KINDS)):
        scored = sorted(((bias + sum(_value(t, x) for t in trees), n, y) for held, k, x, n, y in rows if held and k == kind), reverse=True)
        limit, n_all, y_all = math.inf, 0, 0
        for i, (s, n, y) in enumerate(scored):
            n_all, y_all = n_all + n, y_all + y
            if (i + 1 == len(scored) or scored[i + 1][0] < s) and y_all >= ENOUGH and y_all >= PRECISION * n_all:
                limit = (s + scored[i + 1][0]) / 2 if i + 1 < len(scored) else s  # halfway to the next lower score
        limits.append(limit)
    return bias, trees, limits


def select(proposed: DataFrame, model: tuple[float, list[Tree], list[float]]) -> DataFrame:
    """Adds ``found``: the kind (its place in KINDS), s, e of base spans and of selected proposals outside them, in
    order. A proposal outside them may be confirmed too: the base match may take a neighbour in and then fail."""
    bias, trees, limits = model

    def bit(x: Column, i: int) -> Column:
        return x.bitwiseAND(F.lit(1 << i)) != 0

    def score(x: Column) -> Column:
        out = F.lit(bias)
        for top, (b0, u0, v0), (b1, u1, v1) in trees:
            out = out + F.when(bit(x, top), F.when(bit(x, b1), v1).otherwise(u1)).otherwise(F.when(bit(x, b0), v0).otherwise(u0))
        return out

    def chosen(x: Column) -> Column:
        least = F.lit(math.inf)
        for i, limit in enumerate(limits):
            least = F.when(x["k"] == i, F.lit(limit - 1e-9)).otherwise(least)
        return score(x["x"]) >= least

    def tag(i: int):
        return lambda x: F.struct(x["s"].alias("s"), F.lit(i).alias("k"), x["e"].alias("e"))

    more = F.transform(F.filter("more", chosen), lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))
    return proposed.withColumn("found", F.array_sort(F.array_distinct(F.concat(*[F.transform(k, tag(i)) for i, k in enumerate(KINDS)], more))))


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))


def detect(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Returns key, an array of confirmed spans (s, e, m; code points, end exclusive) for each of KINDS, and ``found``
    (s, k, e; k: place in KINDS), the confirmed and the selected ones.

    A null text is empty. Keys may repeat or be null: each row is searched by itself, whole. Too few confirmed
    proposals of a kind: none is added. An empty table gives none; other columns are ignored, whatever their names.
    """
    proposed = checkpoint(propose(_rows(docs, key, text)).drop("t"))
    return select(proposed, learn(proposed)).select(F.col("k").alias(key), *KINDS, "found")


def redact(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The documents with each found span replaced by its kind in brackets, all else as it was; null texts stay null.

    Of overlapping spans, what an earlier one hasn't covered is replaced.
    """
    model = learn(propose(_rows(docs, key, text)).drop("t"))
    names = docs.columns
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(key).alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    rows = select(propose(held), model)
    tags = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def replaced(found: Column, t: Column) -> Column:
        """Between spans the text, for each span its tag, unless an earlier one ends after it."""
        def pieces(top: Column) -> Column:
            until = lambda i: F.when(i == 0, 0).otherwise(F.get(top, i - 1))
            piece = lambda x, i: let(until(i), lambda at: F.when(x["e"] > at, F.concat(cut(t, at, F.greatest(x["s"], at)), F.get(tags, x["k"]))).otherwise(""))
            end = F.get(top, F.size(top) - 1)
            return F.concat(F.array_join(F.transform(found, piece), ""), cut(t, end, F.length("t")))

        return let(maxima(F.transform(found, lambda x: x["e"])), pieces)

    new = let(F.col("found"), lambda found: let(parts(F.col("t")), lambda t: replaced(found, t)))
    new = F.when(F.size("found") > 0, new).otherwise(F.col(f"row.`{text}`"))
    return rows.select(*[(new if c == text else F.col(f"row.`{c}`")).alias(c) for c in names])


def op1_boosted_pii(spark, sf_dir: str) -> DataFrame:
    found = detect(table(spark, sf_dir, "documents"))
    names = F.array(*[F.lit(k) for k in KINDS])
    every = F.array_join(F.transform("found", lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"], x["e"])), ",")
    base = joined([(k, F.col(k)) for k in KINDS])
    return found.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(base.cast("binary"), 256).alias("base_sha256"), every.alias("spans"))
