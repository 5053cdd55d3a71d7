"""Personal data: identifiers of known form, and others that stand where such identifiers stand.

Four forms are searched for as they are; what passes its check is a seed. A wider search finds candidates that look
like identifiers but pass no check. The words around seeds and candidates are lexical patterns: the two words before,
the two after, or one on each side. Patterns and the identifiers that fill them form a graph. A pattern is trusted for a
kind by the weight of that kind's identifiers among its different fillers, where seeds of other kinds and the ordinary
words that fill it anywhere in the corpus count against it, and candidates count by their own score. A candidate is as
certain as the confident patterns that it fills. Both are computed in turns, ``ROUNDS`` times, so that patterns without
enough seeds of their own are learnt from what others have found. Candidates of confident patterns are added, wherever
they stand.

Only DataFrame functions are used. Texts are searched where they are read; only matches are shuffled, as rows of a text's
128-bit key, so copies of a text are searched for once beyond that. Of a text's words only those in a pattern's place
leave the task, where patterns fit the broadcast bound.
"""

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from kbspark.llm.common import free_name, small_side, stored, text_key

KINDS = ("email", "ip", "card", "phone")

# Runs of characters are taken whole (possessive), so that searches are linear and do not recurse; where a run may not
# be entered halfway the search says so.
_SEARCHES = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}

# Candidates: addresses without a domain's dot or with a written-out at sign; hexadecimal groups; long numbers.
WIDE = (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++ ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]++"
        r"(?:(?:\.| ?\(dot\) ?| ?\[dot\] ?)[A-Za-z0-9-]++)*+"
        r"|(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{0,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])"
        r"|(?<![0-9A-Za-z])\(?[0-9](?:[ ().-]{0,2}[0-9])++(?![0-9A-Za-z])")

_IP_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_GAP, _WORD = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"

# Characters beside a match that are searched for context words.
CONTEXT = 100

# Different identifiers that a pattern must have, the confidence from which it finds new ones, and turns.
SUPPORT = 3
CONFIDENCE = 0.7
ROUNDS = 3

# Bytes of a broadcast pattern.
_PATTERN_BYTES = 240


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _matches(text: Column, search: str, kind: str) -> Column:
    """Matches in their order, with the number of characters before each and the characters around it."""
    values, gaps = F.regexp_extract_all(text, F.lit(search), F.lit(0)), F.split(text, search, -1)
    size = F.size(values)
    before = F.zip_with(values, F.slice(gaps, F.lit(1), size), lambda value, gap: F.struct(
        F.lit(kind).alias("kind"), value.alias("value"), F.length(gap).alias("gap"),
        F.substring(gap, -CONTEXT, CONTEXT).alias("before")))
    return F.zip_with(before, F.slice(gaps, F.lit(2), size), lambda one, gap: F.struct(
        one["kind"].alias("kind"), one["value"].alias("value"), one["gap"].alias("gap"), one["before"].alias("before"),
        F.length(gap).alias("gap_after"), F.substring(gap, 1, CONTEXT).alias("after")))


def _checked(kind: Column, value: Column) -> Column:
    digits = _digits(value)
    return (F.when(kind == "email", True)
            .when(kind == "ip", value.rlike(rf"^{_IP_PART}(?:\.{_IP_PART}){{3}}$"))
            .when(kind == "card", F.length(digits).between(12, 19) & F.call_function("luhn_check", digits))
            .when(kind == "phone", F.length(digits).between(9, 15)).otherwise(False))


def _kinds(value: Column) -> Column:
    """The kinds that a candidate may be of."""
    size = F.length(_digits(value))
    address, groups = value.rlike(r"@|\(at\)|\[at\]"), F.contains(value, F.lit(":"))
    number = ~address & ~groups
    quad = value.rlike(r"^[0-9]+(?:\.[0-9]+){3}$")
    return F.array_compact(F.array(
        F.when(address, "email"), F.when(~address & (groups | quad), "ip"), F.when(number & size.between(12, 19), "card"),
        F.when(number & size.between(7, 15), "phone")))


def _instance(value: Column) -> Column:
    """What is the same identifier written in another way: letters in lower case, numbers without separators."""
    return F.when(value.rlike("[A-Za-z@:]"), F.lower(value)).when(F.startswith(value, F.lit("+")), F.concat(F.lit("+"), _digits(value))
                  ).when(value.rlike(r"^[0-9]+(?:\.[0-9]+){3}$"), value).otherwise(_digits(value))


def _patterns(rows: DataFrame) -> Column:
    """The patterns around a match. Words that touch the match or may go on beyond ``CONTEXT`` are not used."""
    before = F.when(F.col("gap") > CONTEXT, F.regexp_replace("before", f"^{_WORD}+", "")).otherwise(F.col("before"))
    after = F.when(F.col("gap_after") > CONTEXT, F.regexp_replace("after", f"{_WORD}+$", "")).otherwise(F.col("after"))
    left = F.regexp_extract_all(F.lower(F.regexp_replace(before, f"{_WORD}+$", "")), F.lit(f"{_WORD}+"), F.lit(0))
    right = F.regexp_extract_all(F.lower(F.regexp_replace(after, f"^{_WORD}+", "")), F.lit(f"{_WORD}+"), F.lit(0))
    last, first = F.try_element_at(left, F.lit(-1)), F.get(right, F.lit(0))
    ends = [("L", F.try_element_at(left, F.lit(-2)), last), ("M", last, first), ("R", first, F.get(right, F.lit(1)))]
    return F.array_compact(F.array(*[
        F.when(one.isNotNull() & other.isNotNull(), F.concat_ws(" ", F.lit(side), one, other)) for side, one, other in ends]))


def _found(texts: DataFrame) -> DataFrame:
    """Seeds and candidates of each different text: ``(key, kind, start, end, value, patterns)``; candidates of no kind.

    Candidates that share a character with a seed are left out. Places are code points.
    """
    text = F.col("text")
    has_digit = text.rlike("[0-9]")
    wanted = {"email": F.contains(text, F.lit("@")), "ip": has_digit, "card": has_digit, "phone": F.contains(text, F.lit("+"))}
    empty = F.array().cast("array<struct<kind:string,value:string,gap:int,before:string,gap_after:int,after:string>>")
    parts = [F.when(wanted[kind], _matches(text, search, kind)).otherwise(empty) for kind, search in _SEARCHES.items()]
    parts.append(F.when(text.rlike(r"[0-9@:]|\(at\)|\[at\]"), _matches(text, WIDE, "")).otherwise(empty))
    # The outer form keeps Spark from adding a filter on the array's size, which would search every text twice.
    rows = texts.select("key", F.posexplode_outer(F.concat(*parts)).alias("place", "match")).filter("place IS NOT NULL")
    rows = rows.select("key", "place", "match.*")
    kind, value = F.col("kind"), F.col("value")
    used = F.when(kind == "", F.size(_kinds(value)) > 0).otherwise(_checked(kind, value))
    # Matches that fail only move the others.
    rows = rows.select("key", "place", "kind", used.alias("used"), "gap", F.length(value).alias("size"),
                       *[F.when(used, F.col(name)).alias(name) for name in ("value", "before", "after", "gap_after")]).distinct()
    in_order = W.partitionBy("key", "kind").orderBy("place").rowsBetween(W.unboundedPreceding, W.currentRow)
    end = F.sum(F.col("gap") + F.col("size")).over(in_order)
    placed = rows.withColumn("end", end).filter("used").withColumn("start", F.col("end") - F.col("size"))
    seed, by_start = kind != "", W.partitionBy("key").orderBy("start")
    ended = F.max(F.when(seed, F.col("end"))).over(by_start.rangeBetween(W.unboundedPreceding, W.currentRow))
    begins = F.min(F.when(seed, F.col("start"))).over(by_start.rangeBetween(W.currentRow, W.unboundedFollowing))
    apart = ~F.coalesce((ended > F.col("start")) | (begins < F.col("end")), F.lit(False))
    return placed.withColumn("apart", apart).filter(seed | F.col("apart")).select(
        "key", "kind", "start", "end", "value", _patterns(placed).alias("patterns"))


def _edges(found: DataFrame) -> DataFrame:
    """``(pattern, instance, kind, seed)``: different identifiers of each pattern that may find some."""
    value = F.col("value")
    rows = found.select(F.explode("patterns").alias("pattern"), _instance(value).alias("instance"), "kind", F.when(
        F.col("kind") == "", _kinds(value)).otherwise(F.array("kind")).alias("kinds")).distinct()
    rows = stored(rows, "pattern-fillers")
    enough = rows.select("pattern", "instance").distinct().groupBy("pattern").agg(F.count(F.lit(1)).alias("fillers")).filter(
        F.col("fillers") >= SUPPORT)
    seed = (F.col("kind") != "").cast("long")
    seeds = rows.groupBy("pattern").agg(F.sum(seed).alias("seeds"))
    # Only patterns that hold a candidate and would be confident if all their candidates were certain can find any.
    reach = rows.select("pattern", seed.alias("seed"), F.explode("kinds").alias("one")).groupBy("pattern", "one").agg(
        F.count(F.lit(1)).alias("reach"), F.sum("seed").alias("own")).filter("reach > own").join(seeds, "pattern").filter(
            F.col("reach") / (F.col("reach") + F.col("seeds") - F.col("own") + 1) >= CONFIDENCE)
    useful = reach.select("pattern").distinct().join(enough.select("pattern"), "pattern")
    return stored(rows.join(useful, "pattern").select(
        "pattern", "instance", (F.col("kind") != "").alias("seed"), F.explode("kinds").alias("kind")).distinct(), "pattern-graph")


def _ordinary(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """``(pattern, ordinary)``: how many different words without digits or at signs fill each pattern in all texts."""
    parts = F.split("pattern", " ")
    asked = stored(patterns.select("pattern").distinct().select(
        "pattern", *[F.get(parts, F.lit(n)).alias(name) for n, name in enumerate(("side", "one", "other"))]).withColumn(
            "hash", F.xxhash64("side", "one", "other")), "patterns")
    words = F.regexp_extract_all(F.lower("text"), F.lit(f"{_WORD}+"), F.lit(0))
    threes = texts.select(words.alias("words")).select(F.explode_outer(F.transform("words", lambda word, n: F.struct(
        word.alias("a"), F.get("words", n + 1).alias("b"), F.get("words", n + 2).alias("c")))).alias("three")).select("three.*")
    fills = threes.filter("c IS NOT NULL").select(F.explode(F.array(*[
        F.struct(F.xxhash64(F.lit(side), one, other).alias("hash"), F.lit(side).alias("side"), F.col(one).alias("one"),
                 F.col(other).alias("other"), F.col(filler).alias("filler"))
        for side, one, other, filler in (("L", "a", "b", "c"), ("M", "a", "c", "b"), ("R", "b", "c", "a"))])).alias("fill")).select("fill.*")
    hits = fills.join(small_side(asked, _PATTERN_BYTES), ["hash", "side", "one", "other"]).filter(~F.col("filler").rlike("[0-9@]"))
    return stored(hits.select("pattern", "filler").distinct().groupBy("pattern").agg(
        F.count(F.lit(1)).alias("ordinary")), "ordinary-fillers")


def _certain(edges: DataFrame, ordinary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Confidence of patterns ``(pattern, kind, confidence)`` and scores of candidates ``(instance, kind, score)``."""
    seeds = edges.filter("seed").groupBy("pattern").agg(F.count(F.lit(1)).alias("seeds"))
    facts = stored(edges.groupBy("pattern", "kind").agg(F.sum(F.col("seed").cast("long")).alias("own")).join(
        seeds, "pattern", "left").join(ordinary, "pattern", "left").select(
            "pattern", "kind", "own", (F.coalesce("seeds", F.lit(0)) - F.col("own") + F.coalesce("ordinary", F.lit(0))).alias("against")),
        "pattern-facts")
    open_edges, scores = stored(edges.filter("NOT seed").drop("seed"), "candidate-edges"), None
    for _ in range(ROUNDS):
        weight = F.col("own").cast("double")
        known = facts
        if scores is not None:
            gained = open_edges.join(scores, ["instance", "kind"]).groupBy("pattern", "kind").agg(F.sum("score").alias("gained"))
            known = facts.join(gained, ["pattern", "kind"], "left")
            weight = weight + F.coalesce("gained", F.lit(0.0))
        trusted = stored(known.select("pattern", "kind", (weight / (weight + F.col("against") + 1)).alias("confidence")).filter(
            F.col("confidence") >= CONFIDENCE), "confident-patterns")
        doubt = F.exp(F.sum(F.log(1 - F.col("confidence"))))
        scores = stored(open_edges.join(trusted, ["pattern", "kind"]).groupBy("instance", "kind").agg(
            (1 - doubt).alias("score")), "candidate-scores")
    return trusted, scores


def discovered(found: DataFrame, texts: DataFrame) -> DataFrame:
    """``(instance, kind)`` of the candidates that confident patterns find, of the kind with the highest score."""
    edges = _edges(found)
    scores = _certain(edges, _ordinary(texts, edges))[1]
    order = F.element_at(F.create_map(*[item for n, kind in enumerate(KINDS) for item in (F.lit(kind), F.lit(-n))]), F.col("kind"))
    return scores.groupBy("instance").agg(F.max_by("kind", F.struct(F.round("score", 9), order)).alias("kind"))


def spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(key, spans)`` of each different text that has any: kind, start, end, value, and whether it is of known form.

    ``key`` is the MD5 of the text. Spans are ordered by start, then by kind; places are code points, the end exclusive.
    """
    texts = docs.select(F.coalesce(docs[text].cast("string"), F.lit("")).alias("text")).withColumn("key", text_key(F.col("text")))
    found = stored(_found(texts), "identifiers")
    candidates = found.filter("kind = ''").withColumn("instance", _instance(F.col("value"))).drop("kind")
    added = candidates.join(discovered(found, texts), "instance").select(*found.columns, F.lit(False).alias("known"))
    every = found.filter("kind <> ''").withColumn("known", F.lit(True)).unionByName(added)
    number = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    whole = F.sort_array(F.collect_list(F.struct(F.col("start"), number.alias("number"), "end", "kind", "value", "known")))
    return stored(every.groupBy("key").agg(F.transform(whole, lambda s: F.struct(
        *[s[name].alias(name) for name in ("kind", "start", "end", "value", "known")])).alias("spans")), "spans-of-texts")


def with_spans(docs: DataFrame, into: str, text: str = "text") -> DataFrame:
    """``docs`` with an array column ``into`` of the identifiers in each text, as ``spans`` has them.

    Null and empty texts have none, which is an empty array. Rows with equal texts have equal spans. A candidate that
    several kinds claim gets the one of the highest score, then the first of ``KINDS``. All columns and rows stay;
    ``into`` must be a new name. The spans are broadcast where they fit the bound, so that texts are not shuffled.
    """
    key = free_name(docs, "text_md5")
    found = spans(docs, text)
    size = found.agg(F.max(F.size("spans"))).first()[0] or 0
    side = small_side(found.select(F.col("key").alias(key), F.col("spans").alias(into)), 64 + 160 * size)
    marked = docs.withColumn(key, text_key(F.coalesce(docs[text].cast("string"), F.lit(""))))
    return marked.join(side, key, "left").select(
        *docs.columns, F.coalesce(F.col(into), F.array().cast(found.schema["spans"].dataType)).alias(into))


def written(found: Column) -> Column:
    """Spans as text: kind, start and end with colons between, and commas between spans."""
    return F.concat_ws(",", F.transform(found, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
