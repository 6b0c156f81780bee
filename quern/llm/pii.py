r"""Personal data: fixed patterns give seed entities, whose contexts are bootstrapped to find further identifiers.

Everything is DataFrame expressions. Seeds are what the fixed patterns find (emails, IP addresses, card and phone numbers) and
tokens that look like generated keys (SECRET). A candidate is a token with a digit or an at sign, stripped of punctuation.
Its lexical patterns are one, two and three words before it, the word on either side, and the word before with the value's
shape. Spark scores the graph of patterns and values in rounds until nothing new is trusted: a pattern is trusted if it has
enough different known values, most of its values are known, and its words are mostly followed by candidates at all (counts
over the whole corpus); all values of a trusted pattern become known. In the end the trusted patterns are applied to the texts.

The regular expressions are written so that they run in linear time and without deep recursion on any text: quantifiers are
possessive where the language allows it without changing what is matched, and a run of characters is tried from its first
one, or from where the last match ended (\G), only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from quern.llm.store import written

KINDS = ("email", "ip", "card", "phone", "secret")  # the last one has no fixed pattern
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})){3}$"
CANDIDATE = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
SECRET = r"^(?:(?=[0-9]*+[a-f])(?=[a-f]*+[0-9])[0-9a-f]{32,}+|A[KS]IA[0-9A-Z]{16}|gh[oprsu]_[A-Za-z0-9]{36,}+)$"  # seeds only
BLOCK = 256  # matches of a block
CHUNK = 1024  # code points
SENT = 100_000  # patterns that are broadcast
WORD_CHARS = 40  # of a context's word; longer ones make no context

SPANS = "array<struct<start:int,rank:int,end:int>>"
FOUND = "array<struct<start:int,rank:int,end:int,value:string>>"
MARKS = "array<struct<start:int,end:int,contexts:array<string>,value:string>>"


def _let(value: Column, body) -> Column:
    """body(value), value worked out once."""
    return F.get(F.transform(F.array(value), body), 0)


def running(values: Column, op) -> Column:
    """array<int>: op over each value and all before it; op is a sum or a maximum of numbers from 0.

    Block by block, then over the blocks: an aggregate copies its state at each step, which is quadratic in a text's matches.
    """

    def scan(xs: Column) -> Column:
        begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda s, x: F.struct(op(s["at"], x).alias("at"), F.array_append(s["out"], op(s["at"], x)).alias("out"))
        return F.aggregate(xs, begin, step, lambda s: s["out"])

    def over(blocks: Column) -> Column:
        lasts = F.transform(blocks, lambda b: F.element_at(b, -1))
        before = F.concat(F.array(F.lit(0)), F.slice(scan(lasts), 1, F.size(blocks) - 1))
        return F.flatten(F.zip_with(blocks, before, lambda b, at: F.transform(b, lambda x: op(at, x))))

    def cut(v: Column) -> Column:
        at = F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int"))
        return F.transform(at, lambda i: scan(F.slice(v, i * BLOCK + 1, BLOCK)))

    return _let(values, lambda v: F.when(F.size(v) > 0, _let(cut(v), over)).otherwise(F.array().cast("array<int>")))


def located(values: Column, gaps: Column) -> Column:
    """array of (start, end, value, gap) of a pattern's matches, from their texts and the texts between them."""
    sizes = F.zip_with(F.slice(gaps, 1, F.size(values)), values, lambda g, v: F.struct(g.alias("gap"), v.alias("value")))
    ends = running(F.transform(sizes, lambda x: F.length(x["gap"]) + F.length(x["value"])), lambda a, b: a + b)
    return F.zip_with(sizes, ends, lambda x, e: F.struct((e - F.length(x["value"])).alias("start"), e.alias("end"), x["value"].alias("value"), x["gap"].alias("gap")))


def first_after(spans: Column, at: Column) -> Column:
    """The first of spans (sorted, without overlaps) that ends after a place, by halving; null if there is none."""
    half = lambda s: F.shiftright(s["lo"] + s["hi"], 1)
    begin = F.struct(F.lit(0).alias("lo"), F.size(spans).alias("hi"))

    def turn(s: Column, _: Column) -> Column:
        beyond, some = F.get(spans, half(s))["end"] > at, s["lo"] < s["hi"]
        return F.struct(F.when(some & ~beyond, half(s) + 1).otherwise(s["lo"]).alias("lo"), F.when(some & beyond, half(s)).otherwise(s["hi"]).alias("hi"))

    turns = F.sequence(F.lit(1), F.ceil(F.log2(F.size(spans) + 1)).cast("int"))
    return F.when(F.size(spans) > 0, F.aggregate(turns, begin, turn, lambda s: F.get(spans, s["lo"])))


def matches(text: Column, pattern: str) -> tuple[Column, Column]:
    """Leftmost matches that don't overlap, and the texts between them."""
    return F.regexp_extract_all(text, F.lit(pattern), 0), F.split(text, pattern, -1)


def _on_value(test):
    return lambda m: test(m["value"])


def _ranked(rank: int):
    return lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), m["value"].alias("value"))


def _of_rank(rank: int):
    return lambda m: m["rank"] == rank


def base_found(text: Column) -> list[Column]:
    """For each fixed pattern its matches, as arrays of (start, rank, end, value) by start; a null text has none."""
    digits = lambda v: F.regexp_replace(v, r"[^0-9]", "")
    sound = {
        "email": lambda v: F.lit(True),
        "ip": lambda v: v.rlike(OCTETS),
        "card": lambda v: F.length(digits(v)).between(14, 19) & F.call_function("luhn_check", digits(v)),
        "phone": lambda v: F.length(digits(v)).between(10, 15),
    }
    # A text without what every match of a kind has is not searched for it; a card has 14 digits, each after one separator at most.
    worth = {"email": F.contains(text, F.lit("@")), "ip": text.rlike("[0-9]\\.[0-9]"), "card": text.rlike("[0-9](?:[ -]?[0-9]){13}"), "phone": F.contains(text, F.lit("+"))}
    found = []
    for rank, (kind, pattern) in enumerate(zip(KINDS[:4], (EMAIL, IP, CARD, PHONE), strict=True)):
        good = F.filter(located(*matches(text, pattern)), _on_value(sound[kind]))
        spans = F.transform(good, _ranked(rank))
        found.append(F.when(worth[kind], spans).otherwise(F.array().cast(FOUND)))
    return found


def base_spans(text: Column) -> Column:
    """SPANS of the fixed patterns, by start, then kind; a null text has none. rank is the kind's place in KINDS."""
    spans = [F.transform(f, lambda m: F.struct(m["start"].alias("start"), m["rank"].alias("rank"), m["end"].alias("end"))) for f in base_found(text)]
    return F.array_sort(F.coalesce(F.concat(*spans), F.array().cast(SPANS)))


HEAD, TAIL = r"^[^\p{L}\p{N}+@]++", r"(?<![^\p{L}\p{N}])[^\p{L}\p{N}]++$"


def _stripped(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(value, HEAD, ""), TAIL, "")


def _shape(value: Column) -> Column:
    """What a value is made of, and its length."""
    made = F.when(value.rlike("^[0-9]++$"), "d").when(value.rlike("^[0-9a-f]++$"), "h").when(value.rlike("^[A-Za-z0-9]++$"), "n").when(F.contains(value, F.lit("@")), "m").otherwise("x")
    return F.concat(made, F.length(value).cast("string"))


def _normal(word: Column) -> Column:
    return F.translate(F.lower(word), "123456789", "000000000")


def _contexts(before: Column, after: Column, value: Column) -> Column:
    """The lexical patterns of a value between two texts; _ stands for it."""
    # The last three words: found from the end, so that a long text before costs no more than its length.
    last = F.reverse(F.regexp_extract(F.reverse(before), r"^\s*+(\S++(?:\s++\S++){0,2}+)", 1))
    words = F.filter(F.split(_normal(last), r"\s+"), lambda w: w != "")
    follows = _normal(F.regexp_extract(after, r"^\s*+(\S++)", 1))
    one = F.try_element_at(words, F.lit(-1))
    said = lambda n: F.when(F.size(words) >= n, F.concat(F.array_join(F.slice(words, F.size(words) - n + 1, n), " "), F.lit(" _")))
    fit = F.forall(words, lambda w: F.length(w) <= WORD_CHARS)
    sides = F.when((follows != "") & (F.length(follows) <= WORD_CHARS), F.concat(one, F.lit(" _ "), follows))
    listed = F.array(said(1), said(2), said(3), sides, F.concat(one, F.lit(" _:"), _shape(value)))
    return F.when(fit & (F.size(words) > 0), F.filter(listed, lambda c: c.isNotNull())).otherwise(F.array().cast("array<string>"))


def with_candidates(df: DataFrame, text_col: str) -> DataFrame:
    """df with _marks (MARKS): tokens with a digit or at sign, stripped of other characters around them, and their lexical patterns.

    Column by column, so that each regular expression runs once a text, and only on texts that have a candidate.
    """
    text = F.col(text_col)
    has, none = text.rlike("[0-9@]"), F.array().cast("array<string>")
    values, gaps = matches(text, CANDIDATE)
    df = df.withColumn("_values", F.when(has, values).otherwise(none)).withColumn("_gaps", F.when(has, gaps).otherwise(none))
    df = df.withColumn("_found", located(F.col("_values"), F.col("_gaps")))
    n = F.size("_values")
    around = F.zip_with(F.concat(F.array(F.lit("")), F.slice("_values", 1, F.greatest(n - 1, F.lit(0)))), F.slice("_gaps", 2, n), lambda b, a: F.struct(b.alias("before"), a.alias("after")))
    lead = lambda v: F.length(v) - F.length(F.regexp_replace(v, HEAD, ""))
    each = F.zip_with("_found", F.when(n > 0, around).otherwise(F.array().cast("array<struct<before:string,after:string>>")), lambda m, a: F.struct((m["start"] + lead(m["value"])).alias("start"), _stripped(m["value"]).alias("value"), F.concat(a["before"], m["gap"]).alias("before"), a["after"].alias("after")))
    df = df.withColumn("_each", each)
    marks = F.transform("_each", lambda m: F.struct(m["start"].alias("start"), (m["start"] + F.length(m["value"])).alias("end"), _contexts(m["before"], m["after"], m["value"]).alias("contexts"), m["value"].alias("value")))
    return df.withColumn("_marks", F.filter(marks, lambda m: F.size(m["contexts"]) > 0)).drop("_values", "_gaps", "_found", "_each")


@dataclass(frozen=True)
class Bootstrap:
    """When a pattern is trusted: known values, their share of the pattern's values, and the share of its words' occurrences
    that are followed by a candidate. Values of fewer characters are no identifiers. rounds: at most; it ends when nothing is new.
    """

    least_known: int = 4
    least_share: float = 0.6
    least_specific: float = 0.25
    least_chars: int = 4
    rounds: int = 10


def patterns(docs: DataFrame, text_col: str = "text", how: Bootstrap = Bootstrap()) -> DataFrame:  # noqa: B008
    """(context, rank, score) of the trusted patterns, from all documents.

    score: share of known values times the logarithm of their number; rank: the kind most of them have, of equals the first
    in KINDS. Null and empty texts give nothing, an empty table or one without repeated contexts no pattern; repeated rows
    count for how often words occur, not for different values.
    """
    text = F.col("text")
    df = docs.select(F.col(text_col).alias("text")).where(text.rlike("[0-9@]"))
    bases = [f"_base{i}" for i in range(4)]
    df = with_candidates(df.withColumns(dict(zip(bases, base_found(text), strict=True))), "text").select("_marks", *bases)

    def first_over(m: Column) -> Column:
        """The first entity that a token touches."""
        near = [first_after(F.col(b), m["start"]) for b in bases]
        return F.array_min(F.array(*[F.when(s["start"] < m["end"], s) for s in near]))

    seeds = F.transform("_marks", lambda m: F.struct(m.alias("m"), first_over(m).alias("s"), m["value"].rlike(SECRET).alias("secret")))
    # A token inside of an entity that began earlier has no context of its own. Only contexts and values leave the text's row.
    sound = F.filter(seeds, lambda x: x["secret"] | x["s"].isNull() & (F.length(x["m"]["value"]) >= how.least_chars) | (x["s"]["start"] >= x["m"]["start"] - 1))
    own = lambda x: x["secret"] | x["s"].isNull()
    said = F.transform(sound, lambda x: F.struct(F.when(own(x), x["m"]["value"]).otherwise(x["s"]["value"]).alias("value"), F.when(x["secret"], len(KINDS) - 1).otherwise(x["s"]["rank"]).alias("rank"), x["m"]["contexts"].alias("contexts")))
    seen = df.select(F.explode(said).alias("x")).select("x.value", "x.rank", F.explode("x.contexts").alias("context"))
    graph = written(seen.groupBy("context", "value").agg(F.min("rank").alias("rank"), F.count("*").alias("times")), "pii-graph")
    by = graph.groupBy("context").agg(F.sum("times").alias("times"), F.count("*").alias("values")).where(F.col("values") >= how.least_known)
    # A pattern's words: those before the value, and one after it; a shape has the one word before.
    before = F.substring_index("context", " _", 1)
    sided = F.contains("context", F.lit(" _ "))
    likely = written(by.select("context", "times", F.when(sided, F.col("context")).otherwise(before).alias("words"), F.substring_index(before, " ", -1).alias("one")), "pii-contexts")
    n_likely = likely.count()
    few = F.broadcast if n_likely <= SENT else (lambda df: df)  # beyond it, joined by shuffle
    words = F.filter(F.split(_normal(F.col("text")), r"\s+"), lambda w: w != "")
    listed = docs.select(F.col(text_col).alias("text")).select(words.alias("w"))
    around = lambda i: F.struct(F.get("w", i).alias("one"), F.get("w", i - 1).alias("two"), F.get("w", i - 2).alias("three"), F.get("w", i + 2).alias("next"))
    places = F.sequence(F.lit(0), F.size("w") - 1)
    ones = likely.select("one").distinct()
    if n_likely <= LITERALS:  # a set of checked size: words outside of it make no rows
        among = [r["one"] for r in ones.collect()]
        places = F.filter(places, lambda i: F.get("w", i).isin(among))
    # No filter on w: it would be pushed down, and the text cut into words twice.
    near = listed.select(F.explode(F.when(F.size("w") > 0, F.transform(places, around))).alias("t")).select("t.*")
    near = near if n_likely <= LITERALS else near.join(few(ones), "one", "left_semi")
    grams = F.array(F.col("one"), F.concat("two", F.lit(" "), "one"), F.concat("three", F.lit(" "), "two", F.lit(" "), "one"), F.concat("one", F.lit(" _ "), "next"))
    counted = near.select(F.explode(grams).alias("words")).join(few(likely.select("words").distinct()), "words", "left_semi")
    counts = counted.groupBy("words").agg(F.count("*").alias("corpus"))
    specific = written(likely.join(counts, "words").where(F.col("times") >= how.least_specific * F.col("corpus")).select("context"), "pii-specific")
    live = graph.join(specific, "context")
    known = live.where("rank is not null").groupBy("value").agg(F.min("rank").alias("rank"))
    trusted, before = None, -1
    for _ in range(how.rounds):
        linked = live.select("context", "value").join(known, "value", "left")
        one_kind = linked.groupBy("context", "rank").agg(F.count("*").alias("n"))
        of_known = lambda c: F.when(F.col("rank").isNotNull(), c)
        totals = one_kind.groupBy("context").agg(F.sum("n").alias("n_all"), F.coalesce(F.sum(of_known(F.col("n"))), F.lit(0)).alias("n_known"), F.max(of_known(F.struct("n", (-F.col("rank")).alias("r")))).alias("top"))
        good = totals.where((F.col("n_known") >= how.least_known) & (F.col("n_known") >= how.least_share * F.col("n_all")))
        trusted = written(good.select("context", (-F.col("top.r")).alias("rank"), (F.col("n_known") / F.col("n_all") * F.log2(F.col("n_known") + 1)).alias("score")), "pii-trusted")
        if (n := trusted.count()) <= before:
            break
        before = n
        grown = live.select("context", "value").join(trusted, "context").groupBy("value").agg(F.min("rank").alias("rank"))
        known = written(known.unionByName(grown).groupBy("value").agg(F.min("rank").alias("rank")), "pii-known")
    return trusted


LITERALS = 2000  # patterns that are written into the plan; more are joined


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trusted: DataFrame | None = None, others: tuple[str, ...] = (), least_chars: int = Bootstrap.least_chars) -> DataFrame:
    """(id_col, text_col, *others, base, spans) for every row: SPANS of the fixed patterns, and all spans.

    spans has base and, with trusted patterns, the candidates that have one of them (of several kinds, the first in KINDS) and
    touch no base span; secrets may have base spans inside. Null and empty texts have none. Repeated rows are searched each;
    an empty table gives an empty one; columns that others doesn't list are not carried.
    """
    df = docs.select(F.col(id_col).alias(id_col), F.col(text_col).alias(text_col), *others).withColumn("base", base_spans(F.col(text_col)))
    n = trusted.count() if trusted is not None else 0
    if not n:
        return df.withColumn("spans", F.col("base"))
    secret = len(KINDS) - 1

    def clear(rank, start, end):
        near = [first_after(F.col(f"_base{i}"), start) for i in range(4)]
        touches = F.greatest(*[F.coalesce(s["start"] < end, F.lit(False)) for s in near])
        covered = F.greatest(*[F.coalesce((s["start"] <= start) & (s["end"] >= end), F.lit(False)) for s in near])
        return F.when(rank == secret, ~covered).otherwise(~touches)

    columns = df.columns
    df = with_candidates(df, text_col).withColumns({f"_base{i}": F.filter("base", _of_rank(i)) for i in range(4)})
    marks = F.filter("_marks", lambda m: F.length(m["value"]) >= least_chars)
    if n <= LITERALS:  # sets of checked size
        among = lambda own: lambda c: c.isin(own)
        by_rank: dict[int, list[str]] = {}
        for r in trusted.select("context", "rank").collect():
            by_rank.setdefault(r["rank"], []).append(r["context"])
        rank_of = lambda m: F.coalesce(*[F.when(F.exists(m["contexts"], among(own)), F.lit(rank)) for rank, own in sorted(by_rank.items())])
        ranked = F.filter(F.transform(marks, lambda m: F.struct(m["start"].alias("start"), rank_of(m).alias("rank"), m["end"].alias("end"))), lambda m: m["rank"].isNotNull())
        more = F.filter(ranked, lambda m: clear(m["rank"], m["start"], m["end"]))
        return df.select(*columns, F.array_sort(F.concat("base", more)).alias("spans"))
    # Equal texts have equal spans: join by a digest of the text.
    digest = F.sha2(F.col(text_col), 256)
    free = F.transform(marks, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["contexts"].alias("contexts"), clear(F.lit(0), m["start"], m["end"]).alias("other"), clear(F.lit(secret), m["start"], m["end"]).alias("secret")))
    rows = df.select(digest.alias("_digest"), F.explode(free).alias("m")).select("_digest", "m.*").withColumn("context", F.explode("contexts"))
    met = rows.join(trusted.select("context", "rank"), "context").groupBy("_digest", "start", "end").agg(F.min("rank").alias("rank"), F.first("other").alias("other"), F.first("secret").alias("secret"))
    added = met.where(F.when(F.col("rank") == secret, F.col("secret")).otherwise(F.col("other"))).groupBy("_digest").agg(F.collect_list(F.struct("start", "rank", "end")).alias("_more"))
    joined = df.withColumn("_digest", digest).join(added, "_digest", "left")
    return joined.select(*columns, F.array_sort(F.concat("base", F.coalesce("_more", F.array().cast(SPANS)))).alias("spans"))


def written_spans(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kind = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kind, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["rank"] == KINDS.index(kind))).cast("long")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; of overlapping spans one mark, of the first.

    The text is cut into chunks once, as a place in a long string is found by counting from its begin.
    """
    kind = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), 0)
    ends = F.coalesce(F.array_max(F.transform(spans, lambda x: x["end"])), F.lit(0))
    reached = running(F.transform(spans, lambda x: x["end"]), F.greatest)
    before = F.concat(F.array(F.lit(0)), F.slice(reached, 1, F.size(spans) - 1))

    def part(c: Column, a: Column, b: Column) -> Column:
        first = F.floor(a / CHUNK).cast("int")
        held = F.array_join(F.slice(c, first + 1, F.floor((b - 1) / CHUNK).cast("int") - first + 1), "")
        return F.when(b > a, F.substr(held, a - first * CHUNK + 1, b - a)).otherwise("")

    def joined(c: Column) -> Column:
        pieces = F.zip_with(spans, before, lambda x, at: F.when(x["start"] >= at, F.concat(part(c, at, x["start"]), F.get(kind, x["rank"]))).otherwise(""))
        return F.concat(F.array_join(pieces, ""), part(c, ends, F.length(text)))

    return F.when(F.size(spans) == 0, text).otherwise(_let(chunks, joined))
