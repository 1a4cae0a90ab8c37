"""Secrets in text: fixed patterns, and a battery of randomness tests on tokens, in DataFrame functions alone."""

from __future__ import annotations

import string
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.llm.common import stored

#: Fixed patterns, in their order: kind, pattern, least length, and the group whose length counts (0: the whole match).
#: Runs of hex digits are found as runs of 32 or more, which are the same as the maximal runs that are long enough.
BASE = (
    ("assign", r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 8, 2),
    ("access", r"AKIA[A-Z0-9]+", 16, 0),
    ("hex", r"[0-9a-f]{32,}", 32, 0),
)
ORDER = [*(b[0] for b in BASE), "random"]
#: Lower bounds of the length classes; the first is the least length of a token that is tested.
LENGTHS = (16, 20, 24, 32, 48, 64, 128, 256)
#: Tokens that the tests look at, and the parts of one that separators part.
TOKEN = f"[A-Za-z0-9+/_=-]{{{LENGTHS[0]},}}"
PART = f"[A-Za-z0-9]{{{LENGTHS[0]},}}"
_DIGITS, _LOWER, _UPPER = string.digits, string.ascii_lowercase, string.ascii_uppercase
#: Encodings in the order in which they are inferred: what a token must match, and its symbols in order.
ENCODINGS = (
    ("hex", "^[0-9a-f]+$", _DIGITS + "abcdef"),
    ("HEX", "^[0-9A-F]+$", _DIGITS + "ABCDEF"),
    ("base26", "^[a-z]+$", _LOWER),
    ("BASE26", "^[A-Z]+$", _UPPER),
    ("base36", "^[0-9a-z]+$", _DIGITS + _LOWER),
    ("BASE36", "^[0-9A-Z]+$", _DIGITS + _UPPER),
    ("base52", "^[A-Za-z]+$", _UPPER + _LOWER),
    ("base62", "^[0-9A-Za-z]+$", _UPPER + _LOWER + _DIGITS),
    ("base64", "^[0-9A-Za-z+/_-]+=*$", _UPPER + _LOWER + _DIGITS + "+/"),
)
#: How much text is looked at for a string of ordinary text, in its lengths.
STRETCH = 16
#: Spans are gathered in runs of so many, as an array that grows by one at a time is copied each time.
RUN = 256
_SPAN = "struct<start:int,end:int,begin:int,stop:int,hit:string>"


@dataclass(frozen=True)
class Settings:
    """``fdr``: the rate of false discoveries allowed in each class of encoding and length; ``worst``: the statistic, minus
    the log of Fisher's product, from which on no token passes (a random one is beyond 11.25 once in a thousand);
    ``steps``: how finely it is counted; ``draws``: strings of ordinary text that each document gives to compare with."""

    fdr: float = 0.05
    worst: float = 11.25
    steps: int = 45
    draws: int = 1


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once: lambda variables are not put into what refers to them."""
    return F.transform(F.array(value), use)[0]


def _runs_of(xs: Column) -> Column:
    """Numbers of the runs of ``RUN`` elements; ``xs`` has one at least."""
    return F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / RUN).cast("int"))


def _run(xs: Column, k: Column) -> Column:
    return F.slice(xs, k * RUN + 1, F.lit(RUN))


def matches(text: Column, pattern: str, least: int, group: int) -> Column:
    """Leftmost non-overlapping matches that are long enough: start and end in code points, begin and stop in bytes, hit.

    What lies between matches gives the offsets: splitting and extracting find the same matches. Offsets are summed within
    runs of matches, and then over runs, so that time grows with the matches but for a small power.
    """
    none = F.array().cast(f"array<{_SPAN}>")
    kind = f"struct<at:int,byte:int,out:array<{_SPAN}>>"
    zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("byte"), none.alias("out")).cast(kind)

    def step(state: Column, piece: Column) -> Column:
        gap, hit = piece["gap"], piece["hit"]
        start, begin = state["at"] + F.length(gap), state["byte"] + F.octet_length(gap)
        end, stop = start + F.coalesce(F.length(hit), F.lit(0)), begin + F.coalesce(F.octet_length(hit), F.lit(0))
        size = F.length(F.regexp_extract(hit, pattern, group)) if group else F.length(hit)
        found = F.array(F.struct(start.alias("start"), end.alias("end"), begin.alias("begin"), stop.alias("stop"), hit.alias("hit")))
        return F.struct(end.alias("at"), stop.alias("byte"), F.when(hit.isNotNull() & (size >= least), F.concat(state["out"], found)).otherwise(state["out"]).alias("out")).cast(kind)

    bases = "struct<at:int,byte:int,all:array<struct<at:int,byte:int>>>"

    def base(state: Column, run: Column) -> Column:
        here = F.array(F.struct(state["at"].alias("at"), state["byte"].alias("byte")))
        return F.struct((state["at"] + run["at"]).alias("at"), (state["byte"] + run["byte"]).alias("byte"), F.concat(state["all"], here).alias("all")).cast(bases)

    def placed(runs: Column) -> Column:
        first = F.struct(F.lit(0).alias("at"), F.lit(0).alias("byte"), F.array().cast("array<struct<at:int,byte:int>>").alias("all")).cast(bases)
        both = F.arrays_zip(runs.alias("run"), F.aggregate(runs, first, base)["all"].alias("base"))
        shifted = lambda z: F.transform(z["run"]["out"], lambda s: F.struct((s["start"] + z["base"]["at"]).alias("start"), (s["end"] + z["base"]["at"]).alias("end"), (s["begin"] + z["base"]["byte"]).alias("begin"), (s["stop"] + z["base"]["byte"]).alias("stop"), s["hit"].alias("hit")))
        return F.flatten(F.transform(both, shifted))

    pieces = F.arrays_zip(F.split(text, F.lit(pattern), -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    found = _once(pieces, lambda p: _once(F.transform(_runs_of(p), lambda k: F.aggregate(_run(p, k), zero, step)), placed))
    return F.when(text.rlike(pattern), found).otherwise(none)


def replaced(text: Column, spans: Column, put: Callable[[Column, Column], Column]) -> Column:
    """``text`` with the bytes of each span, in order of their begin, replaced by ``put(end of the spans before, span)``."""
    one, many = "struct<at:int,out:string>", "struct<at:int,out:array<string>>"

    def done(s: Column) -> Column:
        def step(state: Column, x: Column) -> Column:
            gap = F.substring(s["bytes"], state["at"] + 1, F.greatest(x["begin"] - state["at"], F.lit(0))).cast("string")
            return F.struct(F.greatest(state["at"], x["stop"]).alias("at"), F.concat(state["out"], gap, put(state["at"], x)).alias("out")).cast(one)

        def run(state: Column, k: Column) -> Column:
            inner = F.aggregate(_run(s["spans"], k), F.struct(state["at"].alias("at"), F.lit("").alias("out")).cast(one), step)
            return _once(inner, lambda i: F.struct(i["at"].alias("at"), F.concat(state["out"], F.array(i["out"])).alias("out")).cast(many))

        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")).cast(many)
        return _once(F.aggregate(_runs_of(s["spans"]), zero, run), lambda d: F.concat(F.array_join(d["out"], ""), F.substring(s["bytes"], d["at"] + 1, F.octet_length(s["bytes"])).cast("string")))

    return F.when(F.size(spans) > 0, _once(F.struct(text.cast("binary").alias("bytes"), spans.alias("spans")), done)).otherwise(text)


def _of(values: list, index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), index + 1)


def _class(n: Column) -> Column:
    out = F.lit(0)
    for k, least in enumerate(LENGTHS[1:], 1):
        out = F.when(n >= least, k).otherwise(out)
    return out


def _cell(encoding: Column, length: Column) -> Column:
    return encoding * len(LENGTHS) + length


def _upper_tail(z: Column) -> Column:
    """1 - Phi(z), by the usual rational approximation of the error function."""
    def tail(x: Column) -> Column:
        t = 1 / (1 + 0.3275911 * x)
        return 0.5 * t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-x * x)

    x = F.least(F.abs(z), F.lit(30.0)) / (2**0.5)
    return F.when(z >= 0, tail(x)).otherwise(1 - tail(x))


def statistic(token: Column, encoding: Column) -> Column:
    """How unlike a random string over its encoding's alphabet a token is: minus the log of the product of three p-values.

    Chi-squared of its symbols against equal shares (too uneven is unlike), the number of runs above and below the middle
    of the alphabet, and the correlation of neighbours (both sides), each as a normal deviate with the mean and variance
    that random strings of this length have.
    """
    def with_symbols(s: Column) -> Column:
        n = F.length(s["token"]).cast("double")
        chars = F.split(s["token"], "")
        squares = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a + F.pow(n - F.length(F.replace(s["token"], c, F.lit(""))), F.lit(2.0)))
        sides = F.call_function("translate", s["token"], s["symbols"], s["sides"])
        runs = F.length(F.regexp_replace(sides, "l+|h+", "r")).cast("double")
        codes = F.transform(chars, lambda c: F.instr(s["symbols"], c).cast("double"))
        return F.struct(n.alias("n"), F.length(s["symbols"]).cast("double").alias("k"), squares.alias("squares"), runs.alias("runs"), (F.length(sides) - F.length(F.replace(sides, F.lit("h"), F.lit("")))).cast("double").alias("high"), codes.alias("codes"))

    def with_mean(s: Column) -> Column:
        return F.struct(*(s[x].alias(x) for x in ("n", "k", "squares", "runs", "high", "codes")), (F.aggregate(s["codes"], F.lit(0.0), lambda a, x: a + x) / s["n"]).alias("mean"))

    def tested(s: Column) -> Column:
        n, k = s["n"], s["k"]
        chi = (s["squares"] * k / n - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
        low = n - s["high"]
        expected = 2 * s["high"] * low / n + 1
        runs = (s["runs"] - expected) / F.sqrt(F.greatest((expected - 1) * (expected - 2) / (n - 1), F.lit(1e-3)))
        kind = "struct<last:double,both:double,own:double>"
        sums = F.aggregate(s["codes"], F.struct(F.lit(0.0).alias("last"), F.lit(0.0).alias("both"), F.lit(0.0).alias("own")).cast(kind), lambda a, x: _once(x - s["mean"], lambda d: F.struct(d.alias("last"), (a["both"] + a["last"] * d).alias("both"), (a["own"] + d * d).alias("own")).cast(kind)))
        serial = _once(sums, lambda t: t["both"] / F.greatest(t["own"], F.lit(1e-9)) * F.sqrt(n) + 1 / F.sqrt(n))
        least = lambda p: F.log(F.greatest(p, F.lit(1e-100)))
        return -least(_upper_tail(chi)) - least(2 * _upper_tail(F.abs(runs))) - least(2 * _upper_tail(F.abs(serial)))

    symbols = _of([e[2] for e in ENCODINGS], encoding)
    sides = _of(["l" * (len(e[2]) // 2) + "h" * (len(e[2]) - len(e[2]) // 2) for e in ENCODINGS], encoding)
    first = F.struct(token.alias("token"), symbols.alias("symbols"), sides.alias("sides"))
    return _once(first, lambda a: _once(with_symbols(a), lambda b: _once(with_mean(b), tested)))


def _with_encoding(t: Column) -> Column:
    """A token's bare symbols and the number of its encoding, null if it is in none, as numbers are not, or too short."""
    encoding = F.lit(None).cast("int")
    for k in reversed(range(len(ENCODINGS))):
        encoding = F.when(t["hit"].rlike(ENCODINGS[k][1]), k).otherwise(encoding)
    bare = F.regexp_replace(F.translate(t["hit"], "-_", "+/"), "=+$", "")
    encoding = F.when(~t["hit"].rlike("^[0-9]+=*$") & (F.length(bare) >= LENGTHS[0]), encoding)
    return F.struct(*(t[x].alias(x) for x in ("start", "end", "begin", "stop", "parts")), bare.alias("bare"), encoding.alias("encoding"))


def _tested(t: Column, at: Column) -> Column:
    cell, value = _cell(t["encoding"], _class(F.length(t["bare"]))), F.when(t["encoding"].isNotNull(), statistic(t["bare"], t["encoding"]))
    return F.struct(*(t[x].alias(x) for x in ("start", "end", "begin", "stop", "parts")), at.alias("at"), cell.alias("cell"), value.alias("value"))


def _as_span(kind: int) -> Callable[[Column], Column]:
    return lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"), s["begin"].alias("begin"), s["stop"].alias("stop"))


def _key(spans: Column) -> Column:
    """Spans in the order of start, then kind, as kind:start:end joined by commas."""
    return F.concat_ws(",", F.transform(F.sort_array(spans), lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, ORDER)), s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def searched(rows: DataFrame, text: Column, key: Column, settings: Settings) -> DataFrame:
    """``rows`` (whose only columns are kept) with counts of base spans, these together (base) and the tested tokens.

    Tokens are those of the text with base spans blanked, so that no token overlaps one. A token is followed by its parts
    between separators, if it has some; parts tells how many, and is null for a part. After the tokens come strings of
    ordinary text, which have no place (start is null), drawn by a hash of ``key``.
    """
    kept, counts = rows.columns, [f"n_{kind}" for kind, *_ in BASE]
    one = rows.select(*kept, *(matches(text, p, least, group).alias(f"{kind}_spans") for kind, p, least, group in BASE))
    base = F.sort_array(F.concat(*(F.transform(F.col(f"{kind}_spans"), _as_span(k)) for k, (kind, *_) in enumerate(BASE))))
    two = one.select(*kept, *(F.size(f"{kind}_spans").cast("long").alias(f"n_{kind}") for kind, *_ in BASE), base.alias("base"))
    blank = replaced(text, F.col("base"), lambda at, x: F.repeat(F.lit(" "), F.greatest(x["stop"] - F.greatest(at, x["begin"]), F.lit(0))))
    names = ("start", "end", "begin", "stop")

    def with_parts(t: Column) -> Column:
        own = F.when(t["hit"].rlike("[^A-Za-z0-9=]|=[^=]"), matches(t["hit"], PART, LENGTHS[0], 0)).otherwise(F.array().cast(f"array<{_SPAN}>"))
        moved = lambda p: F.struct((t["start"] + p["start"]).alias("start"), (t["start"] + p["end"]).alias("end"), (t["begin"] + p["begin"]).alias("begin"), (t["begin"] + p["stop"]).alias("stop"), p["hit"].alias("hit"), F.lit(None).cast("int").alias("parts"))
        return _once(own, lambda ps: F.concat(F.array(F.struct(*(t[x].alias(x) for x in names), t["hit"].alias("hit"), F.size(ps).alias("parts"))), F.transform(ps, moved)))

    found = F.flatten(F.transform(_once(blank, lambda b: matches(b, TOKEN, LENGTHS[0], 0)), with_parts))
    three = two.select(*kept, *counts, "base", F.transform(found, _with_encoding).alias("found"))
    placeless = lambda x: F.struct(*(F.lit(None).cast("int").alias(n) for n in (*names, "parts")), x["bare"].alias("bare"), x["encoding"].alias("encoding"))
    items = F.concat("found", F.transform(ordinary(text, key, settings), placeless))
    return three.select(*kept, *counts, "base", F.transform(items, _tested).alias("tokens"))


def ordinary(text: Column, key: Column, settings: Settings) -> Column:
    """Strings of ordinary text to compare with: what a stretch of a text has in an encoding's alphabet, bare and encoding.

    Tokens long enough to be tested are left out of it. Encoding, length and place follow from a hash of ``key``; the stretch
    is ``STRETCH`` times as long as the string, and gives none if that is too short.
    """
    def draw(k: Column) -> Column:
        mark = F.xxhash64(key, k)
        encoding = F.pmod(mark, F.lit(len(ENCODINGS))).cast("int")
        least = _of(list(LENGTHS), F.pmod(F.shiftright(mark, 40), F.lit(len(LENGTHS))).cast("int"))
        place = F.pmod(F.shiftright(mark, 17), F.greatest(F.length(text) - STRETCH * least + 1, F.lit(1))).cast("int") + 1
        here = F.substring(text, place, STRETCH * least)

        def string_of(s: Column) -> Column:
            upper = _of([e[0] in ("HEX", "BASE26", "BASE36") for e in ENCODINGS], s["encoding"])
            lower = _of([e[0] in ("hex", "base26", "base36") for e in ENCODINGS], s["encoding"])
            cased = F.when(upper, F.upper(s["here"])).when(lower, F.lower(s["here"])).otherwise(s["here"])
            bare = F.regexp_replace(cased, _of([f"{TOKEN}|[^{e[2]}]+" for e in ENCODINGS], s["encoding"]), F.lit(""))
            return F.struct(F.when(F.length(bare) >= s["least"], F.substring(bare, F.lit(1), s["least"])).alias("bare"), s["encoding"].alias("encoding"))

        return _once(F.struct(here.alias("here"), encoding.alias("encoding"), least.alias("least")), string_of)

    return F.filter(F.transform(F.sequence(F.lit(1), F.lit(settings.draws)), draw), lambda x: x["bare"].isNotNull())


def limits(rows: DataFrame, settings: Settings) -> dict[int, float]:
    """The limit of each cell that has one, from all documents' tokens and ordinary strings: a table of fixed size.

    Benjamini-Hochberg by cell: a token's p-value is the share of ordinary strings whose statistic is not above its own
    (one more counted on both sides, so that without ordinary strings every p-value is 1 and nothing passes).
    """
    width = settings.worst / settings.steps
    step = F.least(F.floor(F.col("t.value") / width), F.lit(settings.steps)).cast("int")
    table = rows.select(F.explode("tokens").alias("t")).where("t.cell is not null").groupBy("t.cell", F.col("t.start").isNull().alias("known"), step.alias("step")).agg(F.count("*").alias("n")).collect()  # cells x steps at most
    return bounds([(r["cell"], r["known"], r["step"], r["n"]) for r in table], settings)


def bounds(table: list[tuple[int, bool, int, int]], settings: Settings) -> dict[int, float]:
    """Limits by cell from counts by (cell, whether ordinary, step of the statistic)."""
    out = {}
    for cell in sorted({r[0] for r in table}):
        below = {known: [sum(n for c, o, step, n in table if c == cell and o == known and step < k) for k in range(settings.steps + 2)] for known in (False, True)}
        for k in range(settings.steps, 0, -1):
            p = (1 + below[True][k]) / (1 + below[True][-1])
            if below[False][k] and p * below[False][-1] <= settings.fdr * below[False][k]:
                out[cell] = k * settings.worst / settings.steps
                break
    return out


def _all_spans(limit: dict[int, float]) -> Column:
    """Base spans and those of tokens, or else of their parts, under their limit, in order."""
    if not limit:
        return F.col("base")
    known = F.create_map(*(F.lit(x) for kv in limit.items() for x in kv))
    good = lambda t: F.coalesce(t["value"] < F.element_at(known, t["cell"]), F.lit(False))
    own = F.transform(F.filter("tokens", lambda t: t["parts"].isNotNull()), lambda t: F.filter(F.slice("tokens", t["at"] + 1 + F.when(good(t), 0).otherwise(1), F.when(good(t), 1).otherwise(t["parts"])), good))
    return F.sort_array(F.concat("base", F.transform(F.flatten(own), _as_span(len(BASE)))))


def scan(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and found, the spans as an array of structs.

    Base patterns always stay. To them come tokens of 16 and more characters outside base spans that a battery of tests
    can't tell from random strings over their encoding's alphabet, and that ordinary text passes for too seldom: false
    discoveries are held at ``settings.fdr`` in each class of encoding and length, by p-values against strings that the
    documents' own text gives in that alphabet. Where there are too few of them to show that, nothing passes. Numbers are
    no encoding. Null and empty texts have no spans. Repeated rows each give a row; a null doc_id stays null; other
    columns are ignored; no rows give none.
    """
    settings = settings or Settings()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    counts = [f"n_{kind}" for kind, *_ in BASE]
    found = searched(rows, F.col("text"), F.struct("doc_id", "text"), settings)
    found = stored(found.select("doc_id", *counts, "base", "tokens"), "secrets")
    spans = found.select("doc_id", *counts, "base", _all_spans(limits(found, settings)).alias("found"))
    return spans.select("doc_id", *counts, F.sha2(_key(F.col("base")), 256).alias("base_sha256"), _key(F.col("found")).alias("spans"), "found")


def redact(docs: DataFrame, mark: str = "[SECRET]", settings: Settings | None = None) -> DataFrame:
    """``docs`` with each span (overlapping ones as one) replaced by ``mark``, and n_chars of the new text where present.

    Rows without spans stay as they are. Texts are searched once and written with what was found in them; limits are counted
    from that, and applied to it. The columns of ``docs`` travel as one value, so that their names can't clash with any here.
    """
    settings = settings or Settings()
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    found = stored(searched(rows, text, text, settings).select("row", "base", "tokens"), "searched")
    out = found.select("row", _all_spans(limits(found, settings)).alias("spans"))
    new = replaced(text, F.col("spans"), lambda at, x: F.when(x["begin"] >= at, F.lit(mark)).otherwise(F.lit("")))
    out = out.select("row", F.when(F.size("spans") > 0, new).alias("new"))
    columns = []
    for c in docs.columns:
        old = F.col("row").getField(c)
        value = F.coalesce(F.col("new"), old) if c == "text" else F.coalesce(F.length("new").cast(docs.schema[c].dataType), old) if c == "n_chars" else old
        columns.append(value.alias(c))
    return out.select(*columns)
