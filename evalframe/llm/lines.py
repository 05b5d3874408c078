"""Near-duplicate lines by a deletion-neighbourhood join over words and characters.

Two lines are duplicates if their normalised words are equal or, from
``MIN_WORDS`` words on, differ by one inserted, deleted or replaced word. With
``characters``, lines of up to ``MIN_WORDS`` words are also duplicates if their
words, joined by single spaces, differ by one inserted, deleted or replaced
character (from ``MIN_CHARS`` characters on), and longer ones if one space more
or less makes them equal. A line goes if an earlier line (by document id, then
line number) is a duplicate of it.

1. Every text is read once: a line becomes its hash and the hashes of its halves.
   Equal lines meet by hash; the earliest stands for all.
2. One edit leaves the first or the last half of a line as it is, so only lines
   that share a half with another line can have a neighbour. The words of those
   are fetched once, from their earliest place.
3. Those emit every variant with one word deleted, as hashed keys. Lines with
   an equal variant at one position are all within one replacement of each
   other, so each joins the earliest only; a line that equals a variant is
   within one insertion of the lines that emitted it.
4. Every joined pair is verified by its words: equal from the left and from the
   right but for one word.
5. The characters of the shorter lines go through steps 2 to 4 like words. Longer
   lines emit every variant with two neighbouring words written as one; a line
   that equals such a variant is one space away.
6. A line stays if it is the earliest of its kind and near no earlier one, so
   occurrences meet the lines that stay by their place, which is unique.

Everything is DataFrame code. Lines are pre-aggregated to their earliest place
and keys to their earliest line, so a line or a variant shared by a third of all
lines costs each task a row, and pairs are linear in the variants. Running hashes
of a line come from window functions over that line's own words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evalframe.llm.common import NOT_SPACE, fresh_name, text_or_empty, words, written

#: a changed word makes no duplicates of shorter lines
MIN_WORDS = 8
#: nor a changed character of shorter lines: 'la.' and 'de.', or page numbers
MIN_CHARS = 8


def _places(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Lines with a word: their place (null id or not, id, hash of the text, line number) and _raw."""
    t = text_or_empty(F.col(f"`{text}`"))
    i = F.col(f"`{doc_id}`").cast("bigint")
    key = i.isNull().alias("_a"), F.coalesce(i, F.lit(0).cast("bigint")).alias("_b"), F.xxhash64(t).alias("_c")
    return df.select(*key, F.posexplode(F.split(t, "\n")).alias("_d", "_raw")).where(F.col("_raw").rlike(NOT_SPACE))


def _units(w: Column) -> Column:
    """The characters of the words joined by single spaces."""
    return F.split(F.array_join(w, " "), "")


def _half_keys(w: Column) -> Column:
    """First and last halves, for a partner as long and for one a unit shorter."""
    n, keys = F.size(w), []
    for i, q in enumerate((F.floor(n / 2), F.floor((n - 1) / 2))):
        q = q.cast("int")
        head, tail = F.xxhash64(F.lit(0), q, F.slice(w, F.lit(1), q)), F.xxhash64(F.lit(1), q, F.slice(w, n - q + 1, q))
        keys += [head, tail] if i == 0 else [F.when(n % 2 == 0, head), F.when(n % 2 == 0, tail)]
    return F.array(*keys)


def _with_shared_half(first: DataFrame, keys: str) -> DataFrame:
    """(_line) of the lines that share a half with another line."""
    halves = first.select("_line", F.explode(keys).alias("_half")).where("_half is not null")
    shared = halves.groupBy("_half").agg(F.min("_line").alias("_lo"), F.max("_line").alias("_hi")).where("_lo <> _hi").select("_half")
    return halves.join(shared, "_half", "left_semi").select("_line")


def _near_lines(texts: DataFrame, least: int, joins: bool) -> DataFrame:
    """(_line) of every line that is one edit of its units ``_w`` from an earlier one; both have ``least`` units or more.

    With ``joins`` also those that two neighbouring units written as one make equal to a line, or the reverse.
    """
    # running hashes: words before a place as they are, words after it moved one to the left
    each = texts.select("_line", "_first", F.size("_w").alias("_n"), F.posexplode("_w").alias("_at", "_word"))
    stay, move = F.xxhash64("_at", "_word"), F.xxhash64(F.col("_at") - 1, "_word")
    of_line = Window.partitionBy("_line").orderBy("_at")
    before = F.coalesce(F.bit_xor(stay).over(of_line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("bigint"))
    passed = F.bit_xor(move).over(of_line.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    whole = F.bit_xor(move).over(Window.partitionBy("_line"))
    rest_of = before.bitwiseXOR(whole).bitwiseXOR(passed)
    keys = [F.xxhash64(rest_of, F.col("_n") - 1).alias("_key")]
    if joins:  # the next word leaves the moved ones, both as one word take its place
        after = F.lead("_word").over(of_line)
        one = F.xxhash64("_at", F.concat("_word", after))
        keys.append(F.when(after.isNotNull(), F.xxhash64(rest_of.bitwiseXOR(F.xxhash64("_at", after)).bitwiseXOR(one), F.col("_n") - 1)).alias("_joined"))
    variants = written(each.select("_line", "_first", "_at", *keys, "_n"), "variants")
    full = each.groupBy("_line", "_first", "_n").agg(F.bit_xor(stay).alias("_x")).select("_line", "_first", "_n", F.xxhash64("_x", "_n").alias("_key"))

    # one replaced word: the same rest at the same place
    rest = variants.where(F.col("_n") >= least)
    head = rest.groupBy("_key", "_at").agg(F.min(F.struct("_first", "_line")).alias("_head"), F.count(F.lit(1)).alias("_times")).where("_times > 1")
    head = written(head.drop("_times"), "heads")
    replaced = rest.join(head, ["_key", "_at"]).where("_line <> _head._line").select("_line", F.col("_head._line").alias("_by"))
    # one word more: a line that is another's variant; variants meet lines once, without their place
    short = full.where(F.col("_n") >= least).select("_key", F.col("_line").alias("_short"), F.col("_first").alias("_sf"))
    made = variants.select("_line", "_key")
    if joins:
        made = made.unionByName(variants.where("_joined is not null").select("_line", F.col("_joined").alias("_key")))
    hits = written(made.join(short, "_key").drop("_key").join(texts.select("_line", "_first"), "_line"), "hits")
    longer = hits.where("_sf < _first").select("_line", F.col("_short").alias("_by"))
    shorter = hits.where("_first < _sf").groupBy("_short").agg(F.min(F.struct("_first", "_line"))["_line"].alias("_by")).select(F.col("_short").alias("_line"), "_by")
    pairs = replaced.unionByName(longer).unionByName(shorter).distinct()

    # verified by the words
    by = texts.select(F.col("_line").alias("_by"), F.col("_w").alias("_v"))
    both = pairs.join(texts.select("_line", "_w"), "_line").join(by, "_by")

    def same(a: Column, b: Column) -> Column:
        """Words that two arrays share from the start."""
        differs = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
        return F.when(differs == 0, F.greatest(F.size(a), F.size(b))).otherwise(differs - 1)

    n, m = F.size("_w"), F.size("_v")
    alike = same(F.col("_w"), F.col("_v")) + same(F.reverse("_w"), F.reverse("_v"))
    near = (F.abs(n - m) <= 1) & (alike >= F.greatest(n, m) - 1)
    if joins:
        near |= (F.abs(n - m) == 1) & (alike >= F.least(n, m) - 1) & (F.array_join("_w", "") == F.array_join("_v", ""))
    return both.where(near).select("_line")


def _cuts(df: DataFrame, doc_id: str, text: str, characters: bool) -> DataFrame:
    """(_a, _b, _c, _all, _cut) of every text with a line: its lines with a word, and the numbers of those that go."""
    place = ["_a", "_b", "_c", "_d"]
    each = _places(df, doc_id, text).withColumn("_w", words(F.lower("_raw")))
    n = F.size("_w")
    keys = [F.when(n >= MIN_WORDS - 1, _half_keys(F.col("_w"))).alias("_by_word")]
    if characters:
        few = F.transform(F.array(_units(F.col("_w"))), lambda u: F.when(F.size(u) >= MIN_CHARS - 1, _half_keys(u)))[0]
        keys.append(F.when(n <= MIN_WORDS, few).alias("_by_character"))
    lines = written(each.select(*place, F.xxhash64("_w").alias("_line"), *keys), "lines")
    kinds = [c for c in lines.columns if c.startswith("_by_")]
    first = written(lines.groupBy("_line").agg(F.min(F.struct(*place)).alias("_first"), *[F.first(c).alias(c) for c in kinds]), "firsts")

    maybe = [_with_shared_half(first, c).select("_line", *[F.lit(c == k).alias(k) for k in kinds]) for c in kinds]
    maybe = maybe[0].unionByName(maybe[1]) if characters else maybe[0]
    maybe = written(maybe.groupBy("_line").agg(*[F.max(k).alias(k) for k in kinds]), "maybe")
    needed = written(first.select("_line", "_first").join(maybe, "_line").select("_first.*", "_line", *kinds), "needed")
    texts = _places(df, doc_id, text).join(needed, place).dropDuplicates(place)
    texts = written(texts.select("_line", F.struct(*place).alias("_first"), words(F.lower("_raw")).alias("_w"), *kinds), "texts")

    near = _near_lines(texts.where("_by_word"), MIN_WORDS, characters)
    if characters:
        near = near.unionByName(_near_lines(texts.where("_by_character").withColumn("_w", _units(F.col("_w"))), MIN_CHARS, False))
    near = written(near.distinct(), "near")
    stay = first.select("_line", "_first").join(near, "_line", "left_anti").select("_first.*", F.lit(True).alias("_stays"))
    both = lines.select(*place, F.lit(False).alias("_stays")).unionByName(stay).repartition("_a", "_b", "_c")
    at = both.groupBy(*place).agg(F.max("_stays").alias("_stays"))
    return at.groupBy("_a", "_b", "_c").agg(F.count(F.lit(1)).alias("_all"), F.collect_list(F.when(~F.col("_stays"), F.col("_d"))).alias("_cut"))


def dedup_lines(df: DataFrame, doc_id: str = "doc_id", text: str = "text", characters: bool = False) -> DataFrame:
    """All columns of ``df`` plus n_lines, n_removed (lines with a word), and ``text`` without the removed lines.

    Lines without a word always stay. A null text stays null with no lines. Rows
    of one id and equal text count as one document and get equal results; null
    ids come last in the order. An empty table gives no rows. Caller columns
    named n_lines or n_removed are replaced. ``characters`` adds the edits of one
    character to those of one word.
    """
    per_doc = written(_cuts(df, doc_id, text, characters), "cuts")
    of = {c: fresh_name(df, c) for c in ("a", "b", "c", "all", "cut")}
    per_doc = per_doc.select(*[F.col(f"_{c}").alias(name) for c, name in of.items()])
    i, t = F.col(f"`{doc_id}`").cast("bigint"), F.col(f"`{text}`")
    keep = [c for c in df.columns if c not in ("n_lines", "n_removed")]
    key = i.isNull().alias(of["a"]), F.coalesce(i, F.lit(0).cast("bigint")).alias(of["b"]), F.xxhash64(text_or_empty(t)).alias(of["c"])
    rows = df.select(*[F.col(f"`{c}`") for c in keep], *key).join(per_doc, [of["a"], of["b"], of["c"]], "left")
    cut, zero = F.col(of["cut"]), F.lit(0).cast("bigint")
    left = F.filter(F.split(t, "\n"), lambda x, at: ~F.array_contains(cut, at))
    new = F.when(F.size(cut) > 0, F.array_join(left, "\n")).otherwise(t)
    return rows.select(
        *[new.alias(c) if c == text else F.col(f"`{c}`") for c in keep],
        F.coalesce(F.col(of["all"]), zero).alias("n_lines"), F.coalesce(F.size(cut).cast("bigint"), zero).alias("n_removed"),
    )
