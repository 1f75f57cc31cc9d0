"""Personal data by base patterns and bootstrapped contextual extraction, in built-in functions.

Base spans: e-mail addresses, IP addresses, card numbers and phone numbers, leftmost and not
overlapping per kind; matches that fail a kind's check are dropped.

Bootstrapping: strings that look like identifiers are candidates, and the words before them
are lexical patterns (the word before; the two words before). Candidates that a base span
covers are the seeds, wherever else they occur. Over the graph of patterns and distinct
candidates, rounds alternate: a pattern's confidence in a kind is the belief in its candidates
summed over their number (plus one), a candidate's belief is the noisy-or of the confident
patterns around it. A pattern counts once its confidence reaches ``CONFIDENCE`` with belief
worth ``SUPPORT`` candidates. Candidates believed in one round count for all patterns they
follow in the next, seeded or not, until no pattern is new and no confidence moves.
Candidates of a plausible form that follow a confident pattern are spans too, unless they
overlap a base span. Copies of a string count once, so repeated texts add no weight.

NULL and empty texts have no spans. Repeated rows and NULL ids are reported row by row. An
empty table gives no rows. Columns other than the id and the text play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexivane.functions.binding import let
from lexivane.session import cut

KINDS = ("email", "ip", "card", "phone")
CONFIDENCE = 0.8
SUPPORT = 5.0
SETTLED = 1e-6  # a confidence that moves by less stands still
BLOCK = 128  # matches of a text worked off together, so that very many take no quadratic time
PATTERN_BYTES = 4 << 20  # bound of the confident patterns that are broadcast

# Starts are pinned and repeats possessive, so that no text makes matching slower than linear;
# the matches are those of the plain patterns in the comments.
_BASE = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_GUARD = {
    "email": r"@",
    "ip": r"[0-9]\.[0-9]++\.[0-9]",
    "card": r"[0-9](?:[\x20-]?[0-9]){15}",
    "phone": r"\+[0-9]",
}
_PART = "(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_CANDIDATE = (
    r"(?<![A-Za-z0-9])(?:[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]++|\+?\(?[0-9](?:[\x20().-]{0,2}+[0-9]){4,}+"
    r"|[A-Za-z]{1,4}+[0-9][0-9A-Za-z]{4,}+)"
)
_CANDIDATE_GUARD = r"@|[0-9][^A-Za-z\n]{0,12}[0-9][^A-Za-z\n]{0,12}[0-9]"
_ALL = 2**31 - 1  # code points: as many as a text can have
_SPAN = "array<struct<start:int,end:int,value:string>>"
_CANDIDATES = "array<struct<start:int,end:int,value:string,before:string>>"


def _matches(text: Column, pattern: str, context: bool = False) -> Column:
    """Spans (code points, end exclusive) of the matches; with the words before each if asked.

    Splitting and extracting by the same pattern alternate: gap, match, gap, ..., gap. The
    places of very many matches are found block by block from the blocks' lengths.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    kind = _CANDIDATES if context else _SPAN

    def piece(gap: Column, value: Column) -> Column:
        fields = [F.length(gap).alias("gap"), value.alias("value")]
        if context:
            words = F.rtrim(F.regexp_replace(gap, r"\s+", " "))
            fields.append(F.substring_index(words, " ", -2).alias("before"))
        return F.struct(*fields)

    def step(done: Column, x: Column) -> Column:
        start = done["at"] + x["gap"]
        end = start + F.length(x["value"])
        fields = [start.alias("start"), end.alias("end"), x["value"].alias("value")]
        if context:
            fields.append(x["before"].alias("before"))
        more = F.struct(end.alias("at"), F.concat(done["found"], F.array(F.struct(*fields))).alias("found"))
        return F.when(x["value"].isNull(), done).otherwise(more)

    def placed(some: Column, at: Column) -> Column:
        start = F.struct(at.alias("at"), F.array().cast(kind).alias("found"))
        return F.aggregate(some, start, step, lambda done: done["found"])

    def by_block(some: Column) -> Column:
        length = lambda b: F.aggregate(b, F.lit(0), lambda n, x: n + x["gap"] + F.coalesce(F.length(x["value"]), F.lit(0)))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("list"))
        begins = lambda lengths: F.aggregate(
            lengths, start, lambda t, n: F.struct((t["at"] + n).alias("at"), F.concat(t["list"], F.array(t["at"])).alias("list")), lambda t: t["list"]
        )
        return let(_in_blocks(some), lambda bs: F.flatten(F.zip_with(bs, begins(F.transform(bs, length)), placed)))

    pieces = F.zip_with(F.split(text, pattern, -1), found, piece)
    return let(pieces, lambda p: F.when(F.size(p) <= BLOCK, placed(p, F.lit(0))).otherwise(by_block(p)))


def _in_blocks(items: Column) -> Column:
    """An array in slices of ``BLOCK`` items; of one empty slice if it is empty."""
    last = F.floor((F.greatest(F.size(items), F.lit(1)) - 1) / BLOCK).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(items, i * BLOCK + 1, F.lit(BLOCK)))


def _digits(value: Column) -> Column:
    return F.length(F.regexp_replace(value, "[^0-9]", ""))


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^0*{_PART}(?:\.0*{_PART}){{3}}$")
    if kind == "card":
        bare = F.regexp_replace(value, "[^0-9]", "")
        return F.length(bare).between(16, 19) & F.call_function("luhn_check", bare)
    if kind == "phone":
        return _digits(value).between(8, 15)
    return F.lit(True)


def base_spans(text: str | Column, kind: str) -> Column:
    """Array of (start, end, value) of one kind in a text that is not NULL."""
    text = F.col(text) if isinstance(text, str) else text
    found = F.filter(_matches(text, _BASE[kind]), lambda s: _valid(kind, s["value"]))
    return F.when(text.rlike(_GUARD[kind]), found).otherwise(F.array().cast(_SPAN))


def _plausible(kind: Column, value: Column) -> Column:
    """Whether a candidate can be of a kind at all."""
    letters = value.rlike("[A-Za-z]")
    return (
        F.when(kind == "email", value.contains("@"))
        .when(kind == "ip", value.rlike(r"^[0-9]+(?:\.[0-9]+){3}$"))
        .when(kind == "card", ~letters & _digits(value).between(12, 19))
        .when(kind == "phone", ~letters & _digits(value).between(7, 15))
    )


def _contexts(before: Column) -> Column:
    """The word, and the two words, before a candidate, in lower case."""
    words = F.filter(F.split(F.lower(before), r"\s+"), lambda w: w != "")
    one, two = F.slice(words, -1, 1), F.slice(words, -2, 2)
    named = F.array(*[F.array_join(w, " ") for w in (one, two)])
    return F.array_distinct(F.filter(F.when(F.size(words) > 1, named).otherwise(F.slice(named, 1, 1)), lambda p: p.rlike(r"\p{L}")))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, digest of the text, base spans by kind, candidates outside of base spans and
    those that a base span overlaps, each with the kind. A map without shuffle, checkpointed."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(F.col(id_col).alias("doc_id"), text.alias("t")).select("doc_id", "t", F.unhex(F.md5("t")).alias("key"))
    rows = rows.select("doc_id", "key", "t", *[base_spans("t", k).alias(k) for k in KINDS])
    none = F.array().cast(_CANDIDATES)
    seen = F.when(F.col("t").rlike(_CANDIDATE_GUARD), _matches(F.col("t"), _CANDIDATE, context=True)).otherwise(none)
    rows = rows.select("doc_id", "key", *KINDS, seen.alias("seen"))

    def kind_of(c: Column) -> Column:
        cases = F.lit(None).cast("string")
        for kind in reversed(KINDS):
            over = F.exists(F.col(kind), lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"]))
            cases = F.when(over, kind).otherwise(cases)
        return cases

    known = F.transform(
        "seen",
        lambda c: F.struct(
            c["start"].alias("start"), c["end"].alias("end"), c["value"].alias("value"), _contexts(c["before"]).alias("patterns"), kind_of(c).alias("kind")
        ),
    )
    return cut(rows.select("doc_id", "key", *KINDS, known.alias("candidates")))


def learn_patterns(scanned: DataFrame, confidence: float = CONFIDENCE, support: float = SUPPORT) -> DataFrame:
    """(pattern, kind, confidence) of the confident lexical patterns.

    Beliefs are kept per candidate and kind and start from the seeds, so they and the set of
    confident patterns only grow, and the rounds end.
    """
    texts = scanned.filter(F.size("candidates") > 0).select("candidates")
    each = texts.select(F.explode("candidates").alias("c")).select(
        F.explode("c.patterns").alias("pattern"), F.lower("c.value").alias("instance"), F.col("c.kind").alias("seed")
    )
    # one edge per pattern and distinct candidate; a string that was a seed anywhere is one in all its contexts
    edges = cut(each.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")))
    seeds = edges.filter("seed is not null").groupBy("instance").agg(F.max("seed").alias("seed"))
    edges = cut(edges.drop("seed").join(seeds, "instance", "left"))

    def confident(scored: DataFrame) -> DataFrame:
        enough = (F.col("worth") >= support) & (F.col("worth") >= confidence * (F.col("n") + 1))
        return cut(scored.filter(enough).select("pattern", "kind", (F.col("worth") / (F.col("n") + 1)).alias("confidence")))

    def share(k: str) -> Column:
        """Belief from the seeds alone, and the most there can be if all other candidates of the form are believed."""
        seeded = F.coalesce(F.col("seed") == k, F.lit(False))
        able = seeded | (F.col("seed").isNull() & F.coalesce(_plausible(F.lit(k), F.col("instance")), F.lit(False)))
        return F.struct(F.lit(k).alias("kind"), F.count_if(seeded).cast("double").alias("worth"), F.count_if(able).alias("most"))

    counts = edges.groupBy("pattern").agg(F.count("*").alias("n"), F.array(*[share(k) for k in KINDS]).alias("kinds"))
    able = (F.col("most") >= support) & (F.col("most") >= confidence * (F.col("n") + 1))
    stats = cut(counts.select("pattern", "n", F.explode("kinds").alias("s")).select("pattern", "n", "s.*").filter(able).drop("most"))
    accepted = confident(stats)
    if accepted.isEmpty():
        return accepted
    open_edges = edges.filter("seed is null").join(stats.select("pattern", "kind"), "pattern")
    open_edges = cut(open_edges.filter(_plausible(F.col("kind"), F.col("instance"))).select("pattern", "kind", "instance"))
    while True:
        belief = 1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))
        believed = open_edges.join(accepted, ["pattern", "kind"]).groupBy("instance", "kind").agg(belief.alias("belief"))
        # back to all patterns, also those without a seed
        more = open_edges.join(believed, ["instance", "kind"]).groupBy("pattern", "kind").agg(F.sum("belief").alias("more"))
        scored = stats.join(more, ["pattern", "kind"], "left").withColumn("worth", F.col("worth") + F.coalesce("more", F.lit(0.0)))
        last, accepted = accepted, confident(scored)
        moved = accepted.join(last.withColumnRenamed("confidence", "last"), ["pattern", "kind"], "left")
        if moved.filter(F.col("last").isNull() | (F.col("confidence") > F.col("last") + SETTLED)).isEmpty():
            return accepted


def _discovered(scanned: DataFrame, patterns: DataFrame) -> DataFrame:
    """(key, extra spans by kind) of texts with candidates that follow a confident pattern."""
    size = patterns.select(F.sum(F.octet_length("pattern") + 16)).first()[0] or 0
    known = F.broadcast(patterns) if size <= PATTERN_BYTES else patterns
    each = scanned.filter(F.exists("candidates", lambda c: c["kind"].isNull())).dropDuplicates(["key"])
    each = each.select("key", F.explode("candidates").alias("c")).filter("c.kind is null")
    each = each.select("key", "c.start", "c.end", "c.value", F.explode("c.patterns").alias("pattern"))
    hits = each.join(known, "pattern").filter(_plausible(F.col("kind"), F.col("value")))
    one = hits.groupBy("key", "start", "end").agg(F.max(F.struct("confidence", "kind")).alias("b"), F.first("value").alias("value"))
    listed = F.sort_array(F.collect_list(F.struct("start", "end", "value", F.col("b.kind").alias("kind"))))
    return one.groupBy("key").agg(listed.alias("extra"))


def find_pii(scanned: DataFrame, patterns: DataFrame) -> DataFrame:
    """A scan with the method's spans of each text as ``extra``: (start, end, value, kind)."""
    none = F.array().cast("array<struct<start:int,end:int,value:string,kind:string>>")
    if patterns.isEmpty():
        return scanned.withColumn("extra", none)
    return scanned.join(_discovered(scanned, patterns), "key", "left").withColumn("extra", F.coalesce("extra", none))


def span_list(kind: str, spans: Column) -> Column:
    """``kind:start:end`` strings of spans in order."""
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))


def all_spans(kind: str) -> Column:
    """Base and found spans of a kind by start."""
    own = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))
    extra = F.filter("extra", lambda s: s["kind"] == kind)
    return F.array_sort(F.concat(F.transform(kind, own), F.transform(extra, own)))


def report(found: DataFrame) -> DataFrame:
    """Counts of base spans, their digest, and all spans as text."""
    base = F.array_join(F.concat(*[span_list(k, F.col(k)) for k in KINDS]), ",")
    spans = F.array_join(F.concat(*[span_list(k, all_spans(k)) for k in KINDS]), ",")
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), spans.alias("spans"))


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with every span replaced by ``[EMAIL]``, ``[IP]``, ``[CARD]`` or ``[PHONE]``.

    Overlapping spans become one mark, that of the first. NULL stays NULL.
    """
    scanned = scan(df, id_col, text_col)
    patterns = learn_patterns(scanned)
    name, key = "_spans", "_key"
    while name in df.columns or key in df.columns:
        name, key = name + "_", key + "_"
    text = F.col(text_col).cast("string")
    tagged = lambda k, spans: F.transform(
        spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(f"[{k.upper()}]").alias("mark"))
    )
    own = F.concat(*[tagged(k, base_spans(F.coalesce(text, F.lit("")), k)) for k in KINDS])
    if patterns.isEmpty():
        marked = df.withColumn(name, own)
        key_cols = [name]
    else:
        extra = _discovered(scanned, patterns).select(F.col("key").alias(key), F.col("extra").alias(name + "x"))
        marked = df.withColumn(key, F.unhex(F.md5(F.coalesce(text, F.lit(""))))).join(extra, key, "left")
        found = F.transform(
            F.coalesce(F.col(name + "x"), F.array().cast("array<struct<start:int,end:int,value:string,kind:string>>")),
            lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("mark")),
        )
        marked = marked.withColumn(name, F.concat(own, found))
        key_cols = [name, name + "x", key]

    def step(done: Column, s: Column) -> Column:
        gap = F.substr(done["rest"], F.lit(1), s["start"] - done["at"])
        longer = F.greatest(done["at"], s["end"])
        covered = F.struct(longer.alias("at"), F.substr(done["rest"], longer - done["at"] + 1, F.lit(_ALL)).alias("rest"), done["out"].alias("out"))
        rest = F.substr(done["rest"], s["end"] - done["at"] + 1, F.lit(_ALL))
        more = F.struct(s["end"].alias("at"), rest.alias("rest"), F.concat(done["out"], gap, s["mark"]).alias("out"))
        return F.when(s["start"] < done["at"], covered).otherwise(more)

    def masked(block: Column, at: Column) -> Column:
        """What becomes of the text from ``at`` to the end of the block's last span."""
        to = F.aggregate(block, at, lambda m, s: F.greatest(m, s["end"]))
        start = F.struct(at.alias("at"), F.substr(text, at + 1, to - at).alias("rest"), F.lit("").alias("out"))
        return F.aggregate(block, start, step, lambda done: done["out"])

    def reach(blocks: Column) -> Column:
        """How far the spans of the blocks before reach, for each block and at the end."""
        start = F.struct(F.lit(0).alias("at"), F.array(F.lit(0)).alias("list"))
        ends = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda m, s: F.greatest(m, s["end"])))

        def further(t: Column, e: Column) -> Column:
            at = F.greatest(t["at"], e)
            return F.struct(at.alias("at"), F.concat(t["list"], F.array(at)).alias("list"))

        return F.aggregate(ends, start, further, lambda t: t["list"])

    def whole(blocks: Column, at: Column) -> Column:
        pieces = F.zip_with(blocks, F.slice(at, F.lit(1), F.size(blocks)), masked)
        return F.concat(F.array_join(pieces, ""), F.substr(text, F.element_at(at, -1) + 1, F.lit(_ALL)))

    replaced = let(_in_blocks(F.array_sort(F.col(name))), lambda bs: let(reach(bs), lambda at: whole(bs, at)))
    return marked.withColumn(text_col, F.when(F.size(name) > 0, replaced).otherwise(text)).drop(*key_cols)
