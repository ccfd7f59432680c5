"""Benchmark decontamination by template canonicalisation [native].

A text becomes a sequence of tokens in which numbers, units after a number and
names (capitalised words inside a sentence) are typed placeholders, so that a
question with other numbers or names has the template of the original.

1. Windows of WINDOW template tokens are hashed on both sides; the template of a
   window mostly of placeholders says nothing, so its literal words are hashed
   instead. Items shorter than that are one window of their own length; one with
   fewer than MIN_WORDS words besides its slots ("42", "5 kg", "Yes") would be
   found in any text and is not searched.
2. Document windows (hash, document, place) meet the items' hashes in a semi
   join, and what is left is gathered by document. The items' hashes are a plain
   table: broadcast only if it is below Spark's size threshold, and otherwise
   merged, where the adaptive planner can split a window that a third of all
   documents share.
3. Items of one template are one class: equal tokens, and slots that repeat in
   the same places. A class has each of its template windows once, so a document
   with a question that the benchmark has ten thousand variants of meets one class
   and not each variant; only the words of each variant are kept apart, as hashes.
4. Documents with hits alone are read again. The words of each hit are cut out
   of the text before anything is shuffled by hash, and meet the class's window.
   Matched windows give the share of the class's windows found and the slot pairs
   (slot of the class, document's word). Both are judged for each occurrence in the
   document: windows of one alignment (place in the document less place in the
   item), windows of alignments a few tokens apart (a word put in or left out),
   and all windows of the pair. A pair is a leak if in one of these the share
   reaches MIN_SHARE and slots are consistent: as a rule the same slot stands for the same word of the
   document. It is one too if MIN_SHARE of the windows, and of those with slots,
   are found word for word as items of the class have them.

Only DataFrame functions. Hits of a document are gathered in its row, bounded by
its own length.

Defined results: null or empty texts hold no window; null ids match nothing;
equal rows count once; rows that repeat a doc_id or item_id with another text
are judged apart, and the pair is a leak if one of them is; items of one
template are told by the smallest id, and template_classes() tells which these
are; very long texts are
read whole; empty tables give no pairs; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, drop, id_text

WINDOW = 8
MIN_SHARE = 0.3
MIN_CONSISTENT = 0.7
MAX_SLOTS = 4
MIN_WORDS = 3
# Units of measure and currency after a number.
UNITS = (
    "kg g mg lb lbs oz km m cm mm mi ft in yd mph kph s sec min h hr hrs l ml gal"
    " kilograms? grams? pounds? ounces? kilomet(?:er|re)s? met(?:er|re)s? centimet(?:er|re)s? miles? feet foot inch(?:es)? yards?"
    " seconds? minutes? hours? days? weeks? months? years? lit(?:er|re)s? gallons? percent dollars? cents? euros?"
).split()


def marked(text: Column) -> Column:
    """The text with a control mark before each slot: a number, a unit after it, or a name."""
    text = F.regexp_replace(text, r"\p{Nd}+(?:[.,]\p{Nd}+)*", " \x01n$0 ")
    text = F.regexp_replace(text, rf"(\x01n\S+\s+)((?:{'|'.join(UNITS)}|[%$€£°]))(?![\p{{L}}\p{{Nd}}])", "$1\x01u$2 ")
    return F.regexp_replace(text, r"(?<=[\p{Ll},;:] )\p{Lu}[\p{L}'-]*", "\x01p$0")


def tokens(text: Column) -> Column:
    """Words and marked slots in order."""
    spaced = F.trim(F.regexp_replace(marked(text), r"[^\p{L}\p{Nd}\x01%$€£°]+", " "))
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " "))


def template(token: Column) -> Column:
    return F.when(token.startswith("\x01"), F.substring(token, 1, 2)).otherwise(F.lower(token))


def slot_count(token: Column) -> Column:
    return token.startswith("\x01").cast("int")


def doubled(step: int) -> Column:
    """Each hash combined with the one `step` places on; what runs past the end is cut off by prepared()."""
    return F.transform("long", lambda h, i: F.xxhash64(h, F.get("long", i + step)))


def summed(step: int) -> Column:
    return F.transform("hidden", lambda n, i: n + F.coalesce(F.get("hidden", i + step), F.lit(0)))


def short_windows(size: int) -> Column:
    """Hashes of windows of fewer than WINDOW tokens, for items that have no more."""
    one = F.transform(F.sequence(F.lit(0), F.size("hashes") - size), lambda i: F.xxhash64(F.lit(size), *(F.get("hashes", i + k) for k in range(size))))
    return F.when(F.size("hashes") >= size, one).otherwise(F.array().cast("array<bigint>"))


def literal(at: Column) -> Column:
    """Hash of the words themselves, whatever their case and marks, of the window of WINDOW tokens at a place."""
    words = F.regexp_replace(F.array_join(F.slice("toks", at + 1, WINDOW), " "), "\x01[nup]", "")
    return F.xxhash64(F.lit("words"), F.lower(words))


def prepared(own: DataFrame, *keys: str) -> DataFrame:
    """keys, toks, hashes of template tokens, and long: hashes of windows of WINDOW tokens, of the words where most of one is slots."""
    own = own.select(*keys, tokens(F.col("text")).alias("toks"))
    some = F.exists("toks", lambda t: t.startswith("\x01"))
    hashes = F.transform("toks", lambda t: F.xxhash64(template(t)))
    out = own.select(*keys, "toks", hashes.alias("hashes"), F.when(some, F.transform("toks", slot_count)).alias("hidden"))
    out = out.select(*keys, "toks", "hashes", F.col("hashes").alias("long"), "hidden")
    for step in (1, 2, 4):  # of two, four and eight tokens
        out = out.select(*keys, "toks", "hashes", doubled(step).alias("long"), summed(step).alias("hidden"))
    out = out.select(*keys, "toks", "hashes", "hidden", F.slice("long", 1, F.greatest(F.size("long") - (WINDOW - 1), F.lit(0))).alias("long"))
    shown = F.transform("long", lambda h, i: F.when(F.get("hidden", i) <= MAX_SLOTS, h).otherwise(literal(i)))
    return out.select(*keys, "toks", "hashes", F.when(F.col("hidden").isNull(), F.col("long")).otherwise(shown).alias("long"))


def texts_of(rows: DataFrame, key: str, row: str) -> DataFrame:
    """key, row (a hash of the text, which tells rows of one key apart) and text of rows that have a key."""
    return id_text(rows, key).where("doc_id is not null").select(F.col("doc_id").alias(key), row_of(F.col("text")).alias(row), "text")


def window_hashes(size: int) -> Column:
    return F.col("long") if size == WINDOW else short_windows(size)


def searched(items: DataFrame) -> DataFrame:
    """Items that say something: of WINDOW tokens or more, or with MIN_WORDS words besides their slots."""
    words = F.size(F.filter("toks", lambda t: ~t.startswith("\x01")))
    return items.where((F.size("toks") >= WINDOW) | (words >= MIN_WORDS))


def placed_windows(size: int) -> Column:
    return F.transform(window_hashes(size), lambda h, i: F.struct(h.alias("h"), i.alias("at"), F.lit(size).alias("size")))


def sizes_of(windows: DataFrame) -> list[int]:
    """The window sizes in use: WINDOW, and the lengths of shorter items (so at most WINDOW numbers)."""
    return sorted({WINDOW, *(r["n_toks"] for r in windows.where(F.col("n_toks") < WINDOW).select("n_toks").distinct().collect())})


def canonical() -> Column:
    """Tokens of an item with each slot named by its type and the place of its word among the item's slots."""
    slots = F.array_distinct(F.filter("toks", in_slot))
    return F.transform("toks", lambda t: F.when(in_slot(t), F.concat(F.substring(t, 1, 2), F.array_position(slots, t))).otherwise(F.lower(t)))


def classed(items: DataFrame) -> DataFrame:
    """Items with c, the class of their template, and its tokens."""
    return items.withColumn("canon", canonical()).withColumn("c", F.unhex(F.md5(F.array_join("canon", " "))))


def slot_words(names: Column, words: Column) -> Column:
    """Hash of the words in the slots of a window; null if it has none."""
    found = F.filter(F.arrays_zip(names.alias("name"), words.alias("word")), lambda z: in_slot(z["name"]))
    return F.when(F.size(found) > 0, F.xxhash64(F.transform(found, lambda z: z["word"])))


def item_windows(items: DataFrame) -> DataFrame:
    """c, h, where in the item (every place of a window that repeats), its number of tokens, the window's tokens as the class has them, whether h is of words, w (what tells windows of the class apart), and e (hash of the words in its slots)."""
    cases = [F.when(F.size("toks") == n, window_hashes(n)) for n in range(1, WINDOW)]
    hashes = F.coalesce(*cases, window_hashes(WINDOW))
    places = items.select("c", F.size("toks").alias("n_toks"), "toks", "canon", F.posexplode(hashes).alias("place", "h"))
    cut_out = [F.slice(t, F.col("place") + 1, F.least(F.lit(WINDOW), F.col("n_toks"))).alias(n) for t, n in (("canon", "item_toks"), ("toks", "own_toks"))]
    places = places.select("c", "h", "place", "n_toks", *cut_out)
    words = (F.size("item_toks") == WINDOW) & (F.size(F.filter("item_toks", in_slot)) > MAX_SLOTS)
    places = places.withColumn("words", words)
    # windows of words differ from item to item of a class; their places do not
    w = F.when(F.col("words"), F.xxhash64(F.lit("place"), "place")).otherwise(F.col("h"))
    return places.select("c", "h", "place", "n_toks", "item_toks", "words", w.alias("w"), slot_words(F.col("item_toks"), F.col("own_toks")).alias("e"))


def template_classes(benchmark: DataFrame) -> DataFrame:
    """item_id and class_item (the smallest item_id of its template) of all items that are searched for."""
    items = classed(searched(prepared(texts_of(benchmark, "item_id", "item_row").distinct(), "item_id", "item_row")))
    first = items.groupBy("c").agg(F.min("item_id").alias("class_item"))
    return items.select("item_id", "c").distinct().join(first, "c").select("item_id", "class_item").distinct()


def in_slot(word: Column) -> Column:
    return word.startswith("\x01")


def different(column: str, where: Column | None = None, name: str = "n_windows") -> Column:
    """How many different values a group has."""
    return F.size(F.collect_set(F.col(column) if where is None else F.when(where, F.col(column)))).alias(name)


PAIR = ("doc_id", "doc_row", "c")


def occurrences(seen: DataFrame) -> DataFrame:
    """Each matched window once for every occurrence that it is judged in: its alignment, the alignments near it,
    the whole document, and among the windows found word for word."""
    pair = Window.partitionBy(*PAIR)
    order = pair.orderBy("shift")
    room = F.least(F.lit(WINDOW), F.floor(F.col("n_toks") / 2))
    apart = F.coalesce(F.col("shift") - F.lag("shift").over(order) > room, F.lit(False))
    several = F.min("shift").over(pair) < F.max("shift").over(pair)
    out = seen.withColumns({"apart": apart.cast("long"), "several": several})
    near = F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    names = F.when(F.col("several"), F.array(F.concat(F.lit("at "), "shift"), F.concat(F.lit("near "), "near"), F.lit("all"))).otherwise(F.array(F.lit("all")))
    names = F.when(F.col("exact"), F.array_append(names, F.lit("exact"))).otherwise(names)
    return out.withColumn("near", near).select(*PAIR, "w", "words", "pairs", F.explode(names).alias("part"))


def hits(texts: DataFrame, windows: DataFrame) -> DataFrame:
    """doc_id, doc_row and its hits: (h, at, size) of each window that an item has too."""
    own = prepared(texts, "doc_id", "doc_row")
    # a plain table, so that a skewed merge can be split
    wanted = cut(windows.select("h").distinct())
    every = F.concat(*map(placed_windows, sizes_of(windows)))
    placed = own.select("doc_id", "doc_row", F.inline(every))
    out = cut(placed.join(wanted, "h", "left_semi").groupBy("doc_id", "doc_row").agg(F.collect_set(F.struct("h", "at", "size")).alias("hits")))
    drop(wanted)
    return out


def row_of(text: Column) -> Column:
    """What tells rows of one key apart."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def leaks(docs: DataFrame, benchmark: DataFrame, by_row: bool = False) -> DataFrame:
    """Leaks: doc_id (with doc_row if by_row), item_id (the smallest of the template's class) and n_items of the class, with n_windows (different ones of the class) and, of the occurrence that shows most of it, n_found, n_slots (different slots seen) and consistent (share of them that stand for one document word)."""
    items = classed(searched(prepared(texts_of(benchmark, "item_id", "item_row").distinct(), "item_id", "item_row")))
    every = cut(item_windows(items))
    windows = every.drop("e").distinct()
    words = every.where("e is not null").select("c", "place", "e").distinct()
    texts = texts_of(docs, "doc_id", "doc_row")
    found = hits(texts, every)
    # the ids alone are small where few documents have hits: Spark broadcasts them below its threshold, and only the texts they leave are shuffled
    some = texts.join(cut(found.select("doc_id", "doc_row")), ["doc_id", "doc_row"], "left_semi")
    # merged at every size; equal rows of the table are one document from here on
    again = some.hint("merge").join(found, ["doc_id", "doc_row"]).dropDuplicates(["doc_id", "doc_row"]).select("doc_id", "doc_row", "hits", tokens(F.col("text")).alias("toks"))
    words_of = F.transform("hits", lambda x: F.struct(x["h"].alias("h"), x["at"].alias("at"), F.slice("toks", x["at"] + 1, x["size"]).alias("doc_toks")))
    placed = again.select("doc_id", "doc_row", F.inline(words_of)).join(windows, "h")
    placed = placed.select(*PAIR, "w", "n_toks", "place", (F.col("at") - F.col("place")).alias("shift"), "words", "item_toks", "doc_toks", slot_words(F.col("item_toks"), F.col("doc_toks")).alias("e"))
    pairs = F.filter(F.arrays_zip("item_toks", "doc_toks"), lambda z: in_slot(z["item_toks"]))
    placed = placed.join(words.withColumn("said", F.lit(True)), ["c", "place", "e"], "left")
    seen = cut(placed.select(*PAIR, "w", "n_toks", "shift", "words", pairs.alias("pairs"), (F.col("e").isNull() | F.col("said").isNotNull()).alias("exact")))
    drop(found)
    parts = cut(occurrences(seen))
    drop(seen)
    slotted = F.exists("item_toks", in_slot)
    total = windows.groupBy("c").agg(different("w"), different("w", ~F.col("words"), "n_templates"), different("w", slotted, "n_slotted"))
    key = [*PAIR, "part"]
    share = parts.groupBy(*key).agg(different("w", name="n_found"), different("w", ~F.col("words"), "found_templates"), different("w", F.size("pairs") > 0, "found_slotted"))
    slots = parts.select(*key, F.explode("pairs").alias("z")).groupBy(*key, F.col("z.item_toks").alias("slot")).agg((F.min("z.doc_toks") == F.max("z.doc_toks")).alias("one"))
    slots = slots.groupBy(*key).agg(F.count("*").alias("n_slots"), F.avg(F.col("one").cast("double")).alias("consistent"))
    out = share.join(total, "c").join(slots, key, "left")
    out = out.withColumns({"n_slots": F.coalesce("n_slots", F.lit(0)), "consistent": F.coalesce("consistent", F.lit(1.0))})
    # windows of literal words cannot be found in a copy with other values, so the share of templates alone is enough
    templates = (F.col("n_templates") > 0) & (F.col("found_templates") >= MIN_SHARE * F.col("n_templates"))
    enough = ((F.col("n_found") >= MIN_SHARE * F.col("n_windows")) | templates) & (F.col("consistent") >= MIN_CONSISTENT)
    whole = (F.col("part") != "exact") | (F.col("found_slotted") >= MIN_SHARE * F.col("n_slotted"))
    classes = items.groupBy("c").agg(F.min("item_id").alias("item_id"), F.count_distinct("item_id").alias("n_items"))
    out = out.where(enough & whole).join(classes, "c")
    key = ["doc_id", "doc_row", "item_id"] if by_row else ["doc_id", "item_id"]
    best = F.max(F.struct("n_found", "consistent", "n_slots", F.col("n_windows").cast("long").alias("n_windows"), "n_items")).alias("best")
    out = out.groupBy(*key).agg(best)
    return out.select(*key, "best.n_items", "best.n_windows", F.col("best.n_found").cast("long").alias("n_found"), "best.n_slots", "best.consistent")
