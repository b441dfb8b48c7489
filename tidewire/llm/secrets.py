"""Secret scans in DataFrame functions: fixed patterns, and a battery of randomness tests over other long tokens.

Tokens that mix character classes are read in the encoding they fit. Chi-squared uniformity over the encoding's alphabet,
runs about its middle and lag-1 serial correlation each give a p-value for "characters drawn at random"; their
Sidak combination decides. What counts as random is set for each encoding and length band, so that the estimated share
of ordinary tokens among the accepted ones stays below RATE.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, staged

# The base patterns.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LONG = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}$"""
ACCESS = r"(?<![A-Z0-9])AKIA[A-Z0-9]{16,}|AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}"
KINDS = ["assign", "access", "hex", "random"]
#: Encodings in the order in which a token is tried: name, characters, classes that must occur.
ENCODINGS = [
    ("hex", "0123456789abcdef", ["[0-9]", "[a-f]"]),
    ("HEX", "0123456789ABCDEF", ["[0-9]", "[A-F]"]),
    ("lower36", "0123456789abcdefghijklmnopqrstuvwxyz", ["[0-9]", "[a-z]"]),
    ("upper36", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", ["[0-9]", "[A-Z]"]),
    ("alnum62", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", ["[0-9]", "[A-Z]", "[a-z]"]),
    ("base64", "+/0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", ["[0-9]", "[A-Z]", "[a-z]", "[+/]"]),
    ("base64url", "-0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz", ["[0-9]", "[A-Z]", "[a-z]", "[_-]"]),
]
#: Upper ends of the length bands; bins of the p-values; share of ordinary tokens allowed. No p in the lowest bin is accepted.
BANDS, BINS, RATE = (24, 32, 48, 96), 100, 0.05
OPEN, CLOSE, OTHER = "\ue000", "\ue001", "\ufffd"


#: Items that one inner step of a long fold handles.
CHUNK = 128


def in_chunks(items: Column, body) -> Column:
    """body(part) of each run of CHUNK items, joined: what body compares within a part doesn't grow with the list."""

    def cut(held: Column) -> Column:
        parts = F.filter(F.sequence(F.lit(0), F.floor(F.size(held) / CHUNK).cast("int")), lambda c: c * CHUNK < F.size(held))
        return F.flatten(F.transform(parts, lambda c: let(F.slice(held, c * CHUNK + 1, CHUNK), body)))

    return let(items, cut)


def fold(items: Column, state: Column, kind: str, step) -> Column:
    """The array that step(state, item) -> (next state, value) gives over items, in order; kind is the value's type.

    Appending to a growing array costs its length, so CHUNK values are gathered first and joined to the rest at once.
    """
    none = F.array().cast(f"array<{kind}>")
    start = F.struct(state.alias("state"), none.alias("found"))

    def one(acc: Column, item: Column) -> Column:
        after, value = step(acc["state"], item)
        return F.struct(after.alias("state"), F.concat(acc["found"], F.array(value)).alias("found"))

    def whole(held: Column) -> Column:
        def part(acc: Column, c: Column) -> Column:
            inner = F.aggregate(F.slice(held, c * CHUNK + 1, CHUNK), F.struct(acc["state"].alias("state"), none.alias("found")), one)
            return let(inner, lambda i: F.struct(i["state"].alias("state"), F.concat(acc["found"], i["found"]).alias("found")))

        parts = F.sequence(F.lit(0), F.floor((F.size(held) - 1) / CHUNK).cast("int"))
        return F.when(F.size(held) > 0, F.aggregate(parts, start, part, lambda acc: acc["found"])).otherwise(none)

    return let(items, whole)


def spans(text: Column, pattern: str) -> Column:
    """array<struct<start int, end int, value string>>: the matches, in code points, end exclusive.

    Matches are set between two private characters and the pieces' lengths are added up. Where a text holds these
    characters itself, another one stands in for each, so places stay the same.
    """
    clean = F.replace(F.replace(text, F.lit(OPEN), F.lit(OTHER)), F.lit(CLOSE), F.lit(OTHER))
    kind = "struct<start:int,end:int,value:string>"

    def step(at: Column, piece: Column) -> tuple[Column, Column]:
        value = F.substring_index(piece, CLOSE, 1)
        hit = let(value, lambda v: F.struct(at.alias("start"), (at + F.length(v)).alias("end"), v.alias("value")))
        return at + F.length(piece) - 1, hit

    def placed(marked: Column) -> Column:
        found = let(F.split(marked, OPEN, -1), lambda p: fold(F.slice(p, F.lit(2), F.size(p)), F.length(F.element_at(p, 1)), kind, step))
        return F.when(F.contains(marked, F.lit(OPEN)), found).otherwise(F.array().cast(f"array<{kind}>"))

    return let(F.regexp_replace(clean, pattern, OPEN + "$0" + CLOSE), placed)


def _tail(z: Column) -> Column:
    """P(Z > z) for z >= 0 of the normal law, by a rational approximation (error below 1e-7)."""
    t = 1 / (1 + 0.2316419 * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.exp(-z * z / 2) * 0.3989422804014327 * poly


def battery(value: Column) -> Column:
    """struct<encoding string, p double> of a token; null where it fits no encoding. p is uniform if its characters are drawn at random."""
    kind = "struct<name:string,letters:string>"

    def fitting(body: Column) -> Column:
        found = F.lit(None).cast(kind)
        for name, alphabet, classes in reversed(ENCODINGS):
            fits = F.length(F.translate(body, alphabet, "")) == 0
            for c in classes:
                fits = fits & body.rlike(c)
            found = F.when(fits, F.struct(F.lit(name).alias("name"), F.lit(alphabet).alias("letters"))).otherwise(found)
        return let(found, lambda e: F.when(e.isNotNull(), F.struct(e["name"].alias("encoding"), _p(body, e["letters"]).alias("p"))))

    return let(F.regexp_replace(value, "=+$", ""), fitting)


def _p(body: Column, alphabet: Column) -> Column:
    size = F.length(alphabet).cast("double")
    mid = (size - 1) / 2

    def tests(v: Column) -> Column:
        n = F.size(v).cast("double")
        # chi-squared: the sum of squared counts, its mean and variance under equal chances; one pass over the sorted letters
        start = F.struct(F.lit(-1.0).alias("letter"), F.lit(0.0).alias("run"), F.lit(0.0).alias("squares"))
        longer = lambda a, x, run: F.struct(x.alias("letter"), (run + 1).alias("run"), (a["squares"] + 2 * run + 1).alias("squares"))
        squares = F.aggregate(F.sort_array(v), start, lambda a, x: longer(a, x, F.when(x == a["letter"], a["run"]).otherwise(F.lit(0.0))), lambda a: a["squares"])
        chi = squares * size / n - n
        z_chi = (chi - (size - 1)) / F.sqrt(2 * (size - 1) * (n - 1) / n)
        p_chi = F.when(z_chi >= 0, _tail(F.abs(z_chi))).otherwise(1 - _tail(F.abs(z_chi)))
        pairs = F.sequence(F.lit(1), F.size(v) - 1)
        high = F.aggregate(v, F.lit(0.0), lambda a, x: a + F.when(x > mid, 1.0).otherwise(0.0))
        runs = 1 + F.aggregate(pairs, F.lit(0.0), lambda a, i: a + F.when((F.element_at(v, i) > mid) != (F.element_at(v, i + 1) > mid), 1.0).otherwise(0.0))
        mean_runs = 2 * high * (n - high) / n + 1
        var_runs = F.greatest((mean_runs - 1) * (mean_runs - 2) / (n - 1), F.lit(1e-9))
        p_runs = 2 * _tail(F.abs(runs - mean_runs) / F.sqrt(var_runs))
        mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / n

        def serial(m: Column) -> Column:
            around = F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - m) * (x - m))
            along = F.aggregate(pairs, F.lit(0.0), lambda a, i: a + (F.element_at(v, i) - m) * (F.element_at(v, i + 1) - m))
            return 2 * _tail(F.abs(along / F.greatest(around, F.lit(1e-9)) + 1 / n) * F.sqrt(n))

        least = F.least(p_chi, p_runs, let(mean, serial))
        return 1 - F.pow(1 - F.least(F.greatest(least, F.lit(0.0)), F.lit(1.0)), F.lit(3.0))

    return let(F.transform(F.split(body, ""), lambda c: (F.instr(alphabet, c) - 1).cast("double")), tests)


def _band(length: Column) -> Column:
    out = F.lit(len(BANDS))
    for i in range(len(BANDS) - 1, -1, -1):
        out = F.when(length < BANDS[i], i).otherwise(out)
    return out


def thresholds(candidates: DataFrame, rate: float = RATE) -> dict[tuple[str, int], float]:
    """Least p that is accepted, for each (encoding, band).

    Random tokens have uniform p, ordinary ones a small p; so twice the tokens with p over a half are the random ones. At
    threshold t, what exceeds (1 - t) times their number is ordinary; t is the least bin edge at which that is at
    most rate of the accepted. There are len(ENCODINGS) * (len(BANDS) + 1) * BINS counts at most, whatever the corpus.
    """
    bins = candidates.groupBy("encoding", "band", F.least(F.floor(F.col("p") * BINS), F.lit(BINS - 1)).cast("int").alias("bin")).count()
    counts: dict[tuple[str, int], list[int]] = {}
    for r in bins.collect():
        counts.setdefault((r["encoding"], r["band"]), [0] * BINS)[r["bin"]] += r["count"]
    out = {}
    for stratum, n in counts.items():
        drawn = 2 * sum(n[BINS // 2 :])
        for b in range(1, BINS):
            accepted = sum(n[b:])
            if accepted and max(0.0, accepted - (1 - b / BINS) * drawn) <= rate * accepted:
                out[stratum] = b / BINS
                break
    return out


def scan(docs: DataFrame, rate: float = RATE, keep: list[str] | None = None, hits: str = "hits") -> DataFrame:
    """docs' doc_id and the columns in keep, plus hits array<struct<start, kind_no, end, kind>>, sorted by start and kind.

    Kinds assign, access and hex are the fixed patterns; random is what the battery adds: tokens of 20 or more characters
    that overlap none of the others. A null or empty text has no hit. Equal rows have equal hits. An empty table gives an empty one.
    """
    text = F.coalesce("text", F.lit(""))
    kept = [F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep or [])]  # their own names might clash
    found = docs.select(
        "doc_id", *kept,
        F.filter(spans(text, ASSIGN), lambda s: s["value"].rlike(ASSIGN_LONG)).alias("assign"),
        spans(text, ACCESS).alias("access"), spans(text, HEX).alias("hex"), spans(text, TOKEN).alias("tokens"),
    )
    base = F.concat("assign", "access", "hex")
    meets = lambda b, start, end: (b["start"] < end) & (start < b["end"])
    around = lambda part: F.filter(base, lambda b: meets(b, F.element_at(part, 1)["start"], F.element_at(part, -1)["end"]))
    alone = in_chunks(F.col("tokens"), lambda part: let(around(part), lambda near: F.filter(part, lambda t: ~F.exists(near, lambda b: meets(b, t["start"], t["end"])))))
    tested = F.transform(alone, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), battery(t["value"]).alias("got")))
    found = found.withColumn("tested", F.filter(tested, lambda t: t["got"].isNotNull())).drop("tokens")
    bare = lambda name: F.transform(name, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    found = staged(found.withColumns({k: bare(k) for k in KINDS[:3]}), "secrets")
    one = found.select(F.explode("tested").alias("t")).select("t.got.encoding", "t.got.p", _band(F.col("t.end") - F.col("t.start")).alias("band"))
    limits = thresholds(one, rate)
    limit = F.create_map(*[F.lit(x) for (e, b), p in sorted(limits.items()) for x in (f"{e}:{b}", p)]) if limits else F.create_map().cast("map<string,double>")
    stratum = lambda t: F.concat(t["got"]["encoding"], F.lit(":"), _band(t["end"] - t["start"]).cast("string"))
    added = F.filter("tested", lambda t: t["got"]["p"] >= F.try_element_at(limit, stratum(t)))
    hit = lambda name, col: F.transform(col, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(name)).alias("kind_no"), s["end"].alias("end"), F.lit(name).alias("kind")))
    every = F.array_sort(F.concat(*[hit(k, F.col(k)) for k in KINDS[:3]], hit("random", added)))
    return found.select("doc_id", *[F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep or [])], every.alias(hits))


def _joined(hits: Column) -> Column:
    return F.array_join(F.transform(hits, lambda h: F.concat_ws(":", h["kind"], h["start"].cast("string"), h["end"].cast("string"))), ",")


def redact(docs: DataFrame, mark: str = "[secret]", rate: float = RATE) -> DataFrame:
    """docs with each hit in text replaced by mark (hits that overlap by one mark) and n_chars, if there, counted again."""
    own = "__hits"
    rows = scan(docs, rate, [c for c in docs.columns if c != "doc_id"], own)

    # the text before each hit and its mark; hits are cut out of the text CHUNK at a time, so no hit counts the whole text's characters
    def step(state: Column, h: Column) -> tuple[Column, Column]:
        ahead = F.when(h["start"] >= state, F.struct(state.alias("from"), h["start"].alias("to"))).otherwise(F.struct(state.alias("from"), F.lit(-1).alias("to")))
        return F.greatest(state, h["end"]), ahead

    gaps = F.filter(fold(F.col(own), F.lit(0), "struct<from:int,to:int>", step), lambda g: g["to"] >= 0)

    def cut(part: Column) -> Column:
        base = F.element_at(part, 1)["from"]
        near = F.substring(F.col("text"), base + 1, F.element_at(part, -1)["to"] - base)
        pieces = lambda t: F.transform(part, lambda g: F.concat(F.substring(t, g["from"] - base + 1, g["to"] - g["from"]), F.lit(mark)))
        return let(near, pieces)

    last = F.array_max(F.transform(own, lambda h: h["end"]))
    clean = F.concat(F.array_join(in_chunks(gaps, cut), ""), F.substring(F.col("text"), last + 1, F.length("text")))
    rows = rows.withColumn("text", F.when(F.size(own) > 0, clean).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.size(own) > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return rows.select(*docs.columns)


def op1_secrets(docs: DataFrame) -> DataFrame:
    """The rows of query op1."""
    rows = scan(docs)
    count = lambda k: F.size(F.filter("hits", lambda h: h["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("hits", lambda h: h["kind"] != "random")
    return rows.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("hits")).alias("spans"))
