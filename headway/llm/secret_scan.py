"""Secret scans with DataFrame functions only.

Base spans, leftmost non-overlapping by kind: ``assign`` (a credential's name, a sign and a value),
``access`` (access key ids) and ``hex`` (long hexadecimal runs); see the patterns below.

The method adds spans of kind ``random``.  Candidates are runs of 20 or more characters of base-64
alphabets, with their padding, that hold a letter.  Each gets the smallest encoding that holds it (hexadecimal,
base 32, base 64) and a battery of tests of its symbols for uniform randomness:

* chi-squared for the alphabet.  Its statistic grows with the number of coinciding symbol pairs alone, whose
  tail at these lengths (fewer symbols than cells) is that of a Poisson count, not the normal one;
* Wald-Wolfowitz runs about the alphabet's middle;
* serial correlation at lag 1.

The three p-values are combined by Fisher's method.  Over all candidates of the corpus the combined p-values
pass the Benjamini-Hochberg procedure at rate ``FDR``, each divided by its length over the mean length, as a longer
run has more power: what it rejects is structured text and goes.  What remains is tested against the opposite
hypothesis, that it is written language in that encoding, whose coinciding pairs are far more; the lower tail
passes the same length-aware procedure, so that short runs, which no test can tell, are not reported.  Each
procedure needs only a histogram of p-values in ``BINS`` fixed bins, rounded up, so nothing is sorted or gathered.
The text is scanned once: spans and p-values are stored, without the text.

Edge cases: null and empty texts have no spans; equal spans of different kinds all count; repeated rows
give repeated results; null ids are kept; an empty table gives an empty result; other columns are ignored; without
candidates nothing is added; a text of any length is scanned whole, positions cost little more than linear time in
its matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.llm.shared import let, maximal_runs, stored, sums_before, text_rows

#: Fixed values.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,6}"  # signs only as padding: a name before a sign is no part of its value
KINDS = ("assign", "access", "hex", "random")
FDR = 0.01
BINS = 800
_BIN_WIDTH = 0.05  # of -log10 p
#: Symbols, by encoding; the share of coinciding pairs in written language.
ENCODINGS = {
    "hex": ("0123456789abcdef", r"^[0-9a-fA-F]+$", 0.10),
    "base32": ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", r"^[A-Z2-7]+=*$", 0.065),
    "base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", r".", 0.05),
}
_SPAN = "array<struct<start:bigint,end:bigint,text:string>>"
_TEST = "array<struct<start:bigint,end:bigint,n:double,p_random:double,p_language:double>>"


def spans_of(text: Column, pattern: str, value_group: int = 0) -> Column:
    """array of (start, end, text): code point bounds of all matches, and the group's text."""
    pieces, found, values = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group))

    def sizes(s: Column) -> dict[str, Column]:
        return {"gap": F.transform(F.slice(s["pieces"], 1, F.size(s["found"])), F.length), "own": F.transform(s["found"], F.length)}

    def places(s: Column) -> dict[str, Column]:
        return {"at": sums_before(F.zip_with(s["gap"], s["own"], lambda g, m: g + m))}

    def bounds(s: Column) -> dict[str, Column]:
        begin = lambda i: F.get(s["at"], i) + F.get(s["gap"], i)
        return {"out": F.transform(s["values"], lambda v, i: F.struct(begin(i).alias("start"), (begin(i) + F.get(s["own"], i)).alias("end"), v.alias("text")))}

    spans = let(F.struct(pieces.alias("pieces"), found.alias("found"), values.alias("values")), sizes, places, bounds)["out"]
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(_SPAN))


def _upper_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal, by a rational approximation (error under 1e-7)."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    tail = F.exp(-x * x / 2) * 0.3989422804 * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _poisson_tail(t: Column, mean: Column) -> Column:
    """P(count >= t) of a Poisson count, by the Wilson-Hilferty form of its chi-squared tail."""
    z = (F.pow(mean / t, 1 / 3) - (1 - 1 / (9 * t))) * 3 * F.sqrt(t)
    return F.when(t <= 0, 1.0).otherwise(_upper_tail(-z))


def fisher(*p: Column) -> Column:
    """Fisher's combination of three p-values."""
    s = -sum(F.ln(F.greatest(x, F.lit(1e-300))) for x in p)
    return F.exp(-s) * (1 + s + s * s / 2)


def _chain(cands: Column, *steps) -> Column:
    """Each step maps an element; a step's fields are computed once and open to the next."""
    def applied(step):
        return lambda s: F.struct(s.alias("of"), *step(s))

    for step in steps:
        cands = F.transform(cands, applied(step))
    return cands


def battery(cands: Column) -> Column:
    """Of an array of (start, end, text): (start, end, n, p_random, p_language) of each that has symbols to test.

    ``p_random`` is the battery's combined p-value if symbols are uniform and independent.
    """
    clean = lambda t, e: F.when(e == "hex", F.lower(t)).otherwise(F.translate(F.regexp_replace(t, "=+", ""), "-_", "+/"))
    pick = lambda e, f: F.when(e == "hex", f("hex")).when(e == "base32", f("base32")).otherwise(f("base64"))
    square = lambda v: v * v
    zero = F.lit(0.0)

    def encoded(s):
        t = s["text"]
        return [F.when(t.rlike(ENCODINGS["hex"][1]), "hex").when(t.rlike(ENCODINGS["base32"][1]), "base32").otherwise("base64").alias("e")]

    def cleaned(s):
        c, e = clean(s["of"]["text"], s["e"]), s["e"]
        return [c.alias("c"), pick(e, lambda x: F.lit(float(len(ENCODINGS[x][0])))).alias("k"), pick(e, lambda x: F.lit(ENCODINGS[x][2])).alias("ic"), pick(e, lambda x: F.lit(ENCODINGS[x][0])).alias("alphabet")]

    def symbols(s):
        return [F.transform(F.split(s["c"], ""), lambda ch: (F.position(ch, s["alphabet"]) - 1).cast("double")).alias("x"), F.length(s["c"]).cast("double").alias("n"), s["k"].alias("k"), s["ic"].alias("ic"), s["of"]["of"].alias("span")]

    def sums(s):
        x, n = s["x"], s["n"]
        ahead = F.arrays_zip(F.slice(x, 1, F.size(x) - 1).alias("a"), F.slice(x, 2, F.size(x) - 1).alias("b"))
        squares = F.aggregate(F.array_distinct(x), zero, lambda a, v: a + square(F.size(F.filter(x, lambda y: y == v)).cast("double")))
        return [squares.alias("squares"), ahead.alias("pairs"), (F.aggregate(x, zero, lambda a, v: a + v) / n).alias("mean"), F.size(F.filter(x, lambda v: v >= s["k"] / 2)).cast("double").alias("n1")]

    def moments(s):
        k, n, mean, n1 = s["of"]["k"], s["of"]["n"], s["mean"], s["n1"]
        high = lambda v: v >= k / 2
        return [
            F.aggregate(s["of"]["x"], zero, lambda a, v: a + square(v - mean)).alias("var"),
            F.aggregate(s["pairs"], zero, lambda a, p: a + (p["a"] - mean) * (p["b"] - mean)).alias("cov"),
            (F.size(F.filter(s["pairs"], lambda p: high(p["a"]) != high(p["b"]))).cast("double") + 1).alias("runs"),
            (2 * n1 * (n - n1) / n + 1).alias("expected"),
        ]

    def scores(s):
        k, n, ic, squares = (s["of"]["of"][f] if f != "squares" else s["of"][f] for f in ("k", "n", "ic", "squares"))
        run_var = (s["expected"] - 1) * (s["expected"] - 2) / (n - 1)
        all_pairs = n * (n - 1) / 2
        return [
            ((squares - n) / 2).alias("coincident"),
            (all_pairs / k).alias("if_uniform"),
            (all_pairs * ic).alias("if_language"),
            F.when(run_var > 0, F.abs((s["runs"] - s["expected"]) / F.sqrt(run_var))).otherwise(F.sqrt(n)).alias("z_runs"),
            F.when(s["var"] > 0, F.abs(s["cov"] / s["var"] * F.sqrt(n) + 1 / F.sqrt(n))).otherwise(F.sqrt(n)).alias("z_serial"),
        ]

    def tested(s):
        own = s["of"]["of"]["of"]
        p = fisher(_poisson_tail(s["coincident"], s["if_uniform"]), 2 * _upper_tail(s["z_runs"]), 2 * _upper_tail(s["z_serial"]))
        p_language = F.greatest(F.lit(0.0), 1 - _poisson_tail(s["coincident"] + 1, s["if_language"]))
        return F.struct(own["span"]["start"].alias("start"), own["span"]["end"].alias("end"), own["n"].alias("n"), p.alias("p_random"), p_language.alias("p_language"))

    usable = F.filter(_chain(cands, encoded, cleaned, symbols), lambda s: s["n"] >= 8)
    return F.transform(_chain(usable, sums, moments, scores), tested)


def _bin(p: Column, n: Column, mean: float) -> Column:
    """The bin of a p-value weighted by length, rounded up; larger bins hold smaller values."""
    weighted = F.greatest(p * F.lit(mean) / n, F.lit(1e-300))
    return F.greatest(F.lit(0), F.least(F.lit(BINS), F.floor(-F.log10(weighted) / _BIN_WIDTH).cast("int")))


def _candidates(text: Column) -> Column:
    """Runs that aren't digits and signs alone, with their tests."""
    return F.when(text.rlike(CANDIDATE), battery(F.filter(spans_of(text, CANDIDATE), lambda s: s["text"].rlike("[A-Za-z]")))).otherwise(F.array().cast(_TEST))


def _least_bin(hist: dict[int, int], total: int) -> int:
    """The smallest bin that Benjamini-Hochberg accepts among ``total`` hypotheses."""
    upto, least = 0, BINS + 1
    for b in sorted(hist, reverse=True):
        upto += hist[b]
        if b > 0 and 10 ** (-b * _BIN_WIDTH) <= FDR * upto / total:
            least = b
    return least


class CutOff:
    """Mean length of candidates, and the bins from which one counts as structured, and as no language."""

    def __init__(self, mean: float = 1.0, structured: int = BINS + 1, random: int = BINS + 1) -> None:
        self.mean, self.structured, self.random = mean, structured, random

    def structure(self, t: Column) -> Column:
        return _bin(t["p_random"], t["n"], self.mean) >= self.structured

    def secret(self, t: Column) -> Column:
        return ~self.structure(t) & (_bin(t["p_language"], t["n"], self.mean) >= self.random)


def cut_off(tests: DataFrame) -> CutOff:
    """Both procedures over (t: test) of all candidates; BINS + 1 counts each come to the driver."""
    first = tests.agg(F.count("*").alias("total"), F.avg("t.n").alias("mean")).first()
    if not first.total:
        return CutOff()
    t, out = F.col("t"), CutOff(first.mean)
    count = lambda rows, p: {r.bin: r["count"] for r in rows.groupBy(_bin(t[p], t["n"], out.mean).alias("bin")).count().collect()}
    out.structured = _least_bin(count(tests, "p_random"), first.total)
    out.random = _least_bin(count(tests.where(~out.structure(t)), "p_language"), first.total)
    return out


def scan(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key (hash of the text), spans: array of (start, kind_no, end, kind), by start, then kind as listed."""
    rows = text_rows(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    text = F.col("text")
    base = {"assign": F.filter(spans_of(text, ASSIGN, 2), lambda s: F.length(s["text"]) >= 6), "access": spans_of(text, ACCESS), "hex": spans_of(text, HEX)}
    kind = "array<struct<start:bigint,kind_no:int,end:bigint,kind:string>>"

    def named(k: str):
        return lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(k)).alias("kind_no"), s["end"].alias("end"), F.lit(k).alias("kind"))

    known = F.concat(*[F.transform(spans, named(k)).cast(kind) for k, spans in base.items()])
    found = stored(spark, rows.select("doc_id", F.xxhash64("text").alias("text_key"), known.alias("base"), _candidates(text).alias("tests")))
    cut = cut_off(found.where(F.size("tests") > 0).select(F.explode("tests").alias("t")))
    secret = F.transform(F.filter("tests", cut.secret), named("random")).cast(kind)
    return found.select("doc_id", "text_key", F.array_sort(F.concat("base", secret)).alias("spans"))


def report(found: DataFrame) -> DataFrame:
    """The digest columns of ``scan``'s result."""
    base = F.filter("spans", lambda s: s["kind"] != "random")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(k: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")

    return found.select("doc_id", *map(count, KINDS[:3]), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, found: DataFrame, mark: str = "[secret]", *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every maximal span of ``scan``'s result replaced; rows are told by id and text, so repeated ones are all treated."""
    keys = ("doc_id", "text_key")
    spans = found.dropDuplicates(keys).select(*keys, F.explode("spans").alias("s")).select(*keys, "s.start", "s.end")
    cuts = maximal_runs(spans, keys).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cuts"))  # a group is one text
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    both = rows.join(cuts, F.col("id").eqNullSafe(F.col("doc_id")) & (F.xxhash64("text") == F.col("text_key")), "left")

    def cut(s: Column) -> Column:
        end = lambda i: F.coalesce(F.get(s["cuts"], i)["end"], F.lit(0)).cast("int")
        part = lambda first, n: F.substring(s["text"], first + 1, n)
        pieces = F.transform(s["cuts"], lambda c, i: F.concat(part(end(i - 1), c["start"].cast("int") - end(i - 1)), F.lit(mark)))
        return F.concat(F.array_join(pieces, ""), part(end(F.size(s["cuts"]) - 1), F.length(s["text"])))

    new = F.when(F.col("cuts").isNull(), F.col("row").getField(text_col)).otherwise(F.element_at(F.transform(F.array(F.struct("text", "cuts")), cut), 1))
    out = both.select("row", new.alias("new"))
    return out.select(*[F.col("new").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])
