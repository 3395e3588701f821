"""Personal data: fixed patterns, and identifiers that the contexts of known ones reveal.

Everything is DataFrame functions. Base matches are found by one extraction and
one split for each kind; a running sum over piece lengths turns them into code
point spans. The regular expressions are rewritten so that no text makes them
back-track over a run: they start only where a run starts or the last match
ended, and their runs are possessive; the matches are those of the plain forms.

Bootstrapping: base spans are instances, whole and seeds of their kind; so are runs
of words with a digit or an at sign outside of them. The words around an instance (left one, left two,
left and right) are its patterns. Over the graph of patterns and instances, a
few rounds score patterns by the share of their instances' scores, smoothed, and
instances by their best pattern; seeds keep the score 1. Patterns that end over
min_confidence with enough distinct seeds mark further instances, if these have
a shape close to the seeds of the kind: an at sign within where all of those have
one, else from half to one and a half times as many digits; marks and letters as
those have them. A match of a kind's base form that failed its check is none.
All sums are map-side combined; tables of patterns are joined, never collected.

Defined cases: null and empty texts have no spans; a row is known by its place,
so repeated rows and null ids have results of their own; very long runs are
scanned once; with no seeds there are no patterns; extra columns are not read."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugewright.llm.store import keep

KINDS = ("email", "ip", "card", "phone")
#: The base patterns, in a form that never back-tracks over a run.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_NUMBER = r"[+(]*+[0-9][0-9().:+-]*+(?![^\x20\x09-\x0D,;!?])"
#: Words of digits and their marks with single spaces between; or a word with a digit or an at sign.
INSTANCE = rf"(?<![^\x20\x09-\x0D])(?:{_NUMBER}(?:\x20{_NUMBER})*+|[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+)"
BLOCK = 256  # characters of a block in which spans meet
_NEEDS = {"email": "@", "phone": "+", "ip": ".", "card": ""}


@dataclass(frozen=True)
class Bootstrap:
    rounds: int = 3
    min_seeds: int = 5
    min_confidence: float = 0.8
    smoothing: float = 1.0
    context: int = 64  # characters on each side in which the context words are sought
    min_chars: int = 6


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        part = lambda x: F.regexp_replace(x, "^0+", "")
        return F.forall(F.split(m, r"\."), lambda x: (F.length(part(x)) < 3) | (F.length(part(x)) == 3) & (part(x) <= "255"))
    if kind == "phone":
        return F.length(_digits(m)).between(8, 15)
    if kind == "card":
        d = F.transform(F.filter(F.split(F.reverse(_digits(m)), ""), lambda x: x != ""), lambda x: F.ascii(x) - 48)
        total = F.aggregate(F.transform(d, lambda x, i: F.when(i % 2 == 0, x).otherwise(2 * x - F.when(x > 4, 9).otherwise(0))), F.lit(0), lambda a, x: a + x)
        return F.length(_digits(m)).between(16, 19) & (total % 10 == 0)
    return F.lit(True)


def _found(text: Column, pattern: str, around: int) -> Column:
    """The matches in order: m, the length of the text before since the last match, and the text around."""
    m, p = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    fields = lambda x: F.struct(x["m"].alias("m"), F.char_length(x["b"]).alias("before"), *([F.right(x["b"], F.lit(around)).alias("left"), F.left(x["a"], F.lit(around)).alias("right")] if around else []))
    return F.transform(F.arrays_zip(m.alias("m"), F.slice(p, 1, F.size(m)).alias("b"), F.slice(p, 2, F.size(m)).alias("a")), fields)


def _matches(docs: DataFrame, id_col: str, setting: Bootstrap) -> DataFrame:
    """at (the row's place), doc_id and an array of matches for each kind and for instances: a row for each of docs."""
    x = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("at", F.monotonically_increasing_id())
    number = F.col("text").rlike("[0-9]")
    cols = []
    for kind in KINDS:
        need = F.contains(F.col("text"), F.lit(_NEEDS[kind])) & (number if kind != "email" else F.lit(True))
        cols.append(F.when(need, _found(F.col("text"), PATTERNS[kind], 0)).alias(kind))
    cols.append(F.when(number | F.contains(F.col("text"), F.lit("@")), _found(F.col("text"), INSTANCE, setting.context)).alias("instance"))
    return x.select("at", "doc_id", *cols)


def _spans(found: DataFrame, kind: str) -> DataFrame:
    """at, m, start, end (and the texts around) of each match of a kind."""
    rows = found.filter(F.size(kind) > 0).select("at", F.posexplode(kind).alias("i", "x"))
    order = Window.partitionBy("at").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    n = F.char_length("x.m")
    end = F.sum(F.col("x.before") + n).over(order)
    rows = rows.select("at", "x.*", (end - n).alias("start"), end.alias("end"))
    return rows.filter(_valid(kind, F.col("m"))) if kind in KINDS else rows


def base_spans(found: DataFrame) -> DataFrame:
    """at, kind, start, end."""
    out = None
    for k, kind in enumerate(KINDS):
        part = _spans(found, kind).select("at", F.lit(k).alias("kind"), "start", "end")
        out = part if out is None else out.unionByName(part)
    return out


def _word(side: Column, which: int) -> Column:
    words = F.filter(F.split(F.lower(side), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.coalesce(F.try_element_at(words, F.lit(which)), F.lit(""))


def _shape(m: Column) -> list[Column]:
    """Digits, other marks than spaces, letters and an at sign within."""
    count = lambda p: F.char_length(F.regexp_replace(m, p, ""))
    return [count("[^0-9]").alias("digits"), count(r"[\p{L}\p{N}\x20]").alias("marks"), m.rlike(r"\p{L}").alias("letters"), m.rlike("[^@]@[^@]").alias("sign")]


def _touching(inst: DataFrame, base: DataFrame, block: int = BLOCK) -> DataFrame:
    """at, start of each instance and s, e, kind of each base span that shares a character with it.

    Both go to every block of characters they stand in, and meet in the block where
    the later of the two starts, so each pair comes once and a long document's work
    is in proportion to its length, spread over its blocks."""
    blocks = lambda a, z: F.explode(F.sequence(F.floor(F.col(a) / block), F.floor((F.col(z) - 1) / block))).alias("block")
    one = inst.select("at", "start", "end", blocks("start", "end"))
    other = base.select("at", F.col("start").alias("s"), F.col("end").alias("e"), "kind").select("*", blocks("s", "e"))
    both = one.join(other, ["at", "block"]).filter((F.col("s") < F.col("end")) & (F.col("start") < F.col("e")))
    return both.filter(F.col("block") == F.floor(F.greatest("start", "s") / block)).select("at", "start", "s", "e", "kind")


def discovered(found: DataFrame, base: DataFrame, setting: Bootstrap = Bootstrap()) -> DataFrame:
    """at, kind, start, end of the instances that confident patterns reveal and that no base span touches."""
    inst = _spans(found, "instance")
    beside = Window.partitionBy("at").orderBy("start")  # context runs over the instances next to one
    before = F.concat(F.coalesce(F.lag("left").over(beside), F.lit("")), F.coalesce(F.lag("m").over(beside), F.lit("")), "left")
    behind = F.concat("right", F.coalesce(F.lead("m").over(beside), F.lit("")), F.coalesce(F.lead("right").over(beside), F.lit("")))
    around = F.lit(setting.context)
    inst = inst.select("at", "start", "end", "m", F.right(before, around).alias("left"), F.left(behind, around).alias("right"))
    edge = F.char_length(F.regexp_extract("m", r"[^\p{L}\p{N}]*$", 0))
    inst = inst.select("at", "start", (F.col("end") - edge).alias("end"), F.regexp_replace("m", r"[^\p{L}\p{N}]*$", "").alias("m"), "left", "right").filter(F.col("end") > F.col("start"))
    inst = keep(inst.select("at", "start", "end", "m", "left", "right"), "pii-found")
    pairs = keep(_touching(inst, base), "pii-touch")
    # a base span is one instance, with the context around it
    whole = inst.join(pairs, ["at", "start"]).groupBy("at", "s", "e", "kind").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "m"))), lambda x: x["m"]), " ").alias("m"), F.min_by("left", "start").alias("left"), F.max_by("right", "start").alias("right"))
    inst = inst.join(pairs, ["at", "start"], "left_anti").withColumn("kind", F.lit(None).cast("int")).unionByName(whole.drop("s", "e")).withColumnRenamed("kind", "seed")
    one, two, after = _word(F.col("left"), -1), _word(F.col("left"), -2), _word(F.col("right"), 1)
    patterns = F.array(F.concat(F.lit("L1:"), one), F.concat(F.lit("L2:"), two, F.lit(" "), one), F.concat(F.lit("LR:"), one, F.lit(" | "), after))
    inst = keep(inst.filter(one != "").withColumn("p", F.explode(patterns)).select("at", "start", "end", "m", "seed", "p"), "pii-instances")
    edges = keep(inst.groupBy("p", "m").agg(F.min("seed").alias("seed")), "pii-edges")
    scores = edges.filter("seed is not null").groupBy("m", F.col("seed").alias("kind")).agg(F.lit(1.0).alias("score"))
    for _ in range(setting.rounds):
        scores = keep(scores, "pii-scores")
        size = edges.groupBy("p").agg(F.count(F.lit(1)).alias("n"))
        sums = edges.join(scores, "m").groupBy("p", "kind").agg(F.sum("score").alias("s"), F.count_if(F.col("seed") == F.col("kind")).alias("seeds"))
        conf = keep(sums.filter(F.col("seeds") >= setting.min_seeds).join(size, "p").select("p", "kind", (F.col("s") / (F.col("n") + setting.smoothing)).alias("conf")), "pii-patterns")
        found_scores = edges.join(conf, "p").groupBy("m", "kind").agg(F.max("conf").alias("score"))
        seeds = edges.filter("seed is not null").select("m", F.col("seed").alias("kind"), F.lit(1.0).alias("score"))
        scores = found_scores.unionByName(seeds).groupBy("m", "kind").agg(F.max("score").alias("score"))
    strong = conf.filter(F.col("conf") >= setting.min_confidence)
    seeds = inst.filter("seed is not null").select(F.col("seed").alias("kind"), *_shape(F.col("m")))
    usual = seeds.groupBy("kind").agg(F.min("digits").alias("least"), F.max("digits").alias("most"), F.min(F.least("marks", F.lit(1))).alias("some"), F.max("letters").alias("may"), F.min("sign").alias("must"), F.max("sign").alias("can"))
    new = inst.filter("seed is null").filter(F.char_length("m") >= setting.min_chars).join(strong, "p").select("at", "start", "end", "m", "kind", "conf", *_shape(F.col("m"))).join(usual, "kind").filter(~_rejected(F.col("kind"), F.col("m")))
    # close to the seeds: half as many digits up to half as many more, marks, letters and an at sign as they have them
    new = new.filter((2 * F.col("digits") >= F.col("least")) & (2 * F.col("digits") <= 3 * F.col("most")) | F.col("must")).filter((F.col("marks") >= F.col("some")) & (F.col("may") | ~F.col("letters")) & (F.col("sign") | ~F.col("must")) & (F.col("can") | ~F.col("sign")))
    return new.groupBy("at", "start", "end").agg(F.max_by("kind", F.struct("conf", F.negate("kind"))).alias("kind"))


def _rejected(kind: Column, m: Column) -> Column:
    """Whether m is of the base form of the kind but has failed its check, as an address with a part over 255."""
    out = F.lit(False)
    for k, name in enumerate(KINDS[1:], 1):
        out = F.when(kind == k, m.rlike(f"^(?:{PATTERNS[name]})$") & ~_valid(name, m)).otherwise(out)
    return out


def _text(spans: Column) -> Column:
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.get(name, x["kind"]), x["start"], x["end"])), ",")


def report(docs: DataFrame, id_col: str = "doc_id", setting: Bootstrap = Bootstrap()) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base), base_sha256, spans (base and discovered): a row for each row of docs."""
    found = keep(_matches(docs, id_col, setting), "pii-matches")
    base = keep(base_spans(found), "pii-base")
    more = discovered(found, base, setting)
    both = base.withColumn("base", F.lit(True)).unionByName(more.select("at", "kind", "start", "end").withColumn("base", F.lit(False)))
    span = F.struct("kind", "start", "end")
    by = both.groupBy("at").agg(  # a document's own spans
        *[F.count_if((F.col("kind") == k) & F.col("base")).alias(f"n_{kind}") for k, kind in enumerate(KINDS)],
        F.collect_list(F.when(F.col("base"), span)).alias("b"), F.collect_list(span).alias("a"))
    zero = F.lit(0).cast("long")
    out = found.select("at", "doc_id").join(by, "at", "left")
    return out.select("doc_id", *[F.coalesce(f"n_{kind}", zero).alias(f"n_{kind}") for kind in KINDS], F.sha2(F.coalesce(_text(F.col("b")), F.lit("")), 256).alias("base_sha256"), F.coalesce(_text(F.col("a")), F.lit("")).alias("spans"))
