"""Secret scan: fixed patterns plus a battery of randomness tests, in DataFrame operations only.

Patterns find assignments, access keys and long hexadecimal runs. The method then takes every
token of 20 or more base64 characters, infers its encoding (hexadecimal, base32 or base64:
the smallest alphabet that fits), and tests its characters as numbers of that alphabet:

* chi-squared uniformity over equal cells of the alphabet,
* Wald-Wolfowitz runs above and below the middle of the alphabet,
* lag-1 serial correlation.

A token is a candidate secret if all three are what a random string of its length gives
(|z| <= `LIMIT`). Its p-value is that of so low a chi-squared value if the token were written
text, for which the statistic is noncentral with a shift in proportion to the length; so short
tokens cannot have small p-values. Over all tokens of the table, false discoveries are held to
`ALPHA` by the Benjamini-Hochberg step-up within strata of encoding and length. The step-up
works on a histogram of log p-values (at most 9 strata x `BINS` bins), so the driver sees a
table of fixed size however many tokens there are.

Spans are in code points, end exclusive. Method spans that overlap a pattern's span are not
reported again. A null text counts as empty and has no span; rows with equal or null doc_id are
scanned one by one; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .shared import written

# Patterns, in the order in which kinds are listed.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
TOKEN = "[A-Za-z0-9+/_=-]{20,}"
VALUE_LENGTH = 6

# Alphabet, cells of the uniformity test and noncentrality a character, by encoding.
ENCODINGS = {
    "hex": ("0123456789abcdef", 16, 0.6),
    "base32": ("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 8, 0.6),
    "base64": ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 8, 1.37),
}
LENGTHS = (32, 64)
LIMIT = 3.3
ALPHA = 0.05
BINS = 200
#: matches of a text that are added up in one fold
RUN = 128
_SPANS = "array<struct<start:int,rank:int,end:int>>"


def _named(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _found(text: Column, pattern: str, value: int | None = None) -> Column:
    """start, end, match and, for a group number, value of each leftmost non-overlapping match.

    Spark has no positions of matches; they follow from the lengths of the pieces between. The
    pieces are added up in runs of `RUN`, whose own lengths are added up then, as an array that
    grows in a fold is copied at each step."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = matches if value is None else F.regexp_extract_all(text, F.lit(pattern), F.lit(value))
    between = F.split(text, pattern, -1)
    kind = "array<struct<start:int,end:int,match:string,value:string>>"

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["0"])
        end = start + F.length(F.coalesce(x["1"], F.lit("")))
        row = F.struct(start.alias("start"), end.alias("end"), x["1"].alias("match"), x["2"].alias("value"))
        return F.struct(end.alias("at"), F.when(x["1"].isNull(), state["rows"]).otherwise(F.concat(state["rows"], F.array(row))).alias("rows"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("rows"))

    def run_rows(pieces: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / RUN).cast("int"))
        return F.transform(numbers, lambda k: F.aggregate(F.slice(pieces, k * RUN + 1, RUN), zero, step))

    def placed(runs: Column) -> Column:
        ends = F.aggregate(runs, F.array(F.lit(0)), lambda held, r: F.concat(held, F.array(F.element_at(held, -1) + r["at"])))
        return _named(ends, lambda e: F.flatten(F.transform(runs, lambda r, k: F.transform(r["rows"], lambda x: F.struct((x["start"] + F.get(e, k)).alias("start"), (x["end"] + F.get(e, k)).alias("end"), x["match"].alias("match"), x["value"].alias("value"))))))

    rows = _named(_named(F.arrays_zip(between.alias("0"), matches.alias("1"), values.alias("2")), run_rows), placed)
    return F.when(text.rlike(pattern), rows).otherwise(F.array().cast(kind))


def _upper_tail(z: Column) -> Column:
    """P(Z > z) for z >= 0 (Abramowitz and Stegun, 26.2.17)."""
    t = 1 / (1 + 0.2316419 * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.exp(-z * z / 2) * 0.3989422804014327 * poly


def _letters(enc: str) -> tuple[str, str]:
    """For each character of an encoding's alphabet the letter of its cell, and whether it is in the upper half."""
    alphabet, cells, _ = ENCODINGS[enc]
    n = len(alphabet)
    return "".join(chr(97 + i * cells // n) for i in range(n)), "".join("01"[2 * i >= n] for i in range(n))


def _tested(token: Column) -> Column:
    """enc, n and p of a token; p is 1 if a test rejects randomness.

    Cells, halves and their changes are counted by replacing letters in strings, which the JVM does
    in compiled loops; only the serial correlation folds over the characters."""
    # each step names what the next one uses, so that nothing is computed again for every character
    bare = F.regexp_replace(F.translate(token, "-_", "+/"), "=+$", "")
    encoding = lambda b: F.when(b.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex").when(b.rlike("^[A-Z2-7]+$"), "base32").otherwise("base64")
    pick = lambda enc, of: F.when(enc == "hex", of("hex")).when(enc == "base32", of("base32")).otherwise(of("base64"))
    count = lambda text, n, x: (n - F.length(F.replace(text, F.lit(x), F.lit("")))) / len(x)

    def encoded(b: Column) -> Column:
        return _named(encoding(b), lambda enc: F.struct(enc.alias("enc"), F.translate(F.when(enc == "hex", F.lower(b)).otherwise(b), "=", "").alias("shown")))

    def lettered(e: Column) -> Column:
        drawn = lambda k: pick(e["enc"], lambda enc: F.translate(e["shown"], ENCODINGS[enc][0], _letters(enc)[k]))
        x = F.transform(F.slice(F.split(e["shown"], ""), 1, F.length(e["shown"])), lambda c: pick(e["enc"], lambda enc: F.instr(F.lit(ENCODINGS[enc][0]), c) - 1).cast("double"))
        zero = F.struct(F.lit(-1.0).alias("last"), F.lit(-1.0).alias("first"), *(F.lit(0.0).alias(k) for k in ("sum", "square", "product")))

        def step(s: Column, v: Column) -> Column:
            begins = s["last"] < 0
            product = s["product"] + F.when(begins, 0.0).otherwise(s["last"] * v)
            return F.struct(v.alias("last"), F.when(begins, v).otherwise(s["first"]).alias("first"), (s["sum"] + v).alias("sum"), (s["square"] + v * v).alias("square"), product.alias("product"))

        return F.struct(e["enc"].alias("enc"), F.length(e["shown"]).alias("n"), drawn(0).alias("cells"), drawn(1).alias("halves"), F.aggregate(x, zero, step).alias("s"))

    def moments(t: Column) -> Column:
        n = t["n"]
        squares = lambda k: sum((F.pow(count(t["cells"], n, chr(97 + j)), F.lit(2.0)) for j in range(k)), F.lit(0.0))
        many = F.greatest(n, F.lit(1)).cast("double")
        k = pick(t["enc"], lambda enc: F.lit(float(ENCODINGS[enc][1])))
        mean = t["s"]["sum"] / many
        product = t["s"]["product"] - mean * (2 * t["s"]["sum"] - t["s"]["last"] - t["s"]["first"]) + (many - 1) * mean * mean
        return F.struct(
            t["enc"].alias("enc"), n.alias("n"), k.alias("k"), pick(t["enc"], lambda enc: F.lit(ENCODINGS[enc][2])).alias("shift"),
            (pick(t["enc"], lambda enc: squares(ENCODINGS[enc][1])) * k / many - many).alias("chi"),
            count(t["halves"], n, "1").alias("high"), (count(t["halves"], n, "01") + count(t["halves"], n, "10") + 1).alias("runs"),
            (product / F.greatest(t["s"]["square"] - many * mean * mean, F.lit(1e-9))).alias("serial"),
        )

    def verdict(m: Column) -> Column:
        n, freedom = F.greatest(m["n"], F.lit(1)).cast("double"), m["k"] - 1
        low = n - m["high"]
        expected = 2 * m["high"] * low / n + 1
        spread = F.sqrt(F.greatest((expected - 1) * (expected - 2) / F.greatest(n - 1, F.lit(1.0)), F.lit(1e-9)))
        uniform = (F.pow(F.greatest(m["chi"], F.lit(0.0)) / freedom, F.lit(1 / 3)) - (1 - 2 / (9 * freedom))) / F.sqrt(2 / (9 * freedom))
        z = F.greatest(uniform, F.abs((m["runs"] - expected) / spread), F.abs(m["serial"]) * F.sqrt(n))
        shift = n * m["shift"]
        text = (freedom + shift - m["chi"]) / F.sqrt(2 * (freedom + 2 * shift))
        p = F.when((n < 2) | (z > LIMIT) | (text <= 0), F.lit(1.0)).otherwise(_upper_tail(F.greatest(text, F.lit(0.0))))
        return F.struct(m["enc"].alias("enc"), m["n"].alias("n"), p.alias("p"))

    return _named(_named(_named(_named(bare, encoded), lettered), moments), verdict)


def _binned(p: Column) -> Column:
    return F.least(F.floor(-4 * F.log2(F.greatest(p, F.lit(1e-300)))), F.lit(BINS)).cast("int")


def _tokens(text: Column) -> Column:
    """start, end, stratum and bin of each token of 20 or more characters."""

    def row(f: Column) -> Column:
        return _named(_tested(f["match"]), lambda t: F.struct(f["start"].alias("start"), f["end"].alias("end"), F.concat(t["enc"], F.lit(":"), sum((t["n"] >= n).cast("int") for n in LENGTHS).cast("string")).alias("stratum"), _binned(t["p"]).alias("bin")))

    return F.transform(_found(text, TOKEN), row)


def thresholds(counts: list[tuple[str, int, int]], alpha: float = ALPHA) -> dict[str, int]:
    """Least bin that passes, by stratum, from (stratum, bin, tokens)."""
    strata: dict[str, dict[int, int]] = {}
    for stratum, b, n in counts:
        strata.setdefault(stratum, {})[b] = n
    out = {}
    for stratum, bins in strata.items():
        m, held = sum(bins.values()), 0
        for b in range(BINS, 0, -1):
            held += bins.get(b, 0)
            if held and 2.0 ** (-b / 4) * m <= alpha * held:
                out[stratum] = b
    return out


def scan(docs: DataFrame, alpha: float = ALPHA, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and spans: an array of start, rank (of KINDS) and end, in order.

    Texts are scanned once; patterns and tested tokens are kept in a table until the step-up is known."""
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))

    def spans(found: Column, kind: str) -> Column:
        return F.transform(found, lambda f: F.struct(f["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), f["end"].alias("end")))

    assign = spans(F.filter(_found(F.col("text"), ASSIGN, 2), lambda f: F.length(f["value"]) >= VALUE_LENGTH), "assign")
    base = F.concat(assign, spans(_found(F.col("text"), ACCESS), "access"), spans(_found(F.col("text"), HEX), "hex"))
    found = written(texts.select("doc_id", F.array_sort(base).alias("base"), _tokens(F.col("text")).alias("tokens")), "tokens")
    counted = found.select(F.explode("tokens").alias("t")).groupBy("t.stratum", "t.bin").count()
    least = thresholds([tuple(r) for r in counted.collect()], alpha)
    passes = lambda t: reduce(lambda c, s: c | ((t["stratum"] == s) & (t["bin"] >= least[s])), sorted(least), F.lit(False))
    random = spans(F.filter("tokens", passes), "random") if least else F.array().cast(_SPANS)
    rows = found.select("doc_id", "base", random.alias("random"))
    clear = F.filter("random", lambda r: ~F.exists("base", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])))
    return rows.select("doc_id", "base", F.array_sort(F.concat("base", clear)).alias("spans"))


def report(docs: DataFrame) -> DataFrame:
    shown = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["rank"] == k)).cast("bigint").alias(f"n_{KINDS[k]}")
    return scan(docs).select("doc_id", count(0), count(1), count(2), F.sha2(shown("base"), 256).alias("base_sha256"), shown("spans").alias("spans"), count(3))
