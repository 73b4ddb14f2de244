"""Fuzzy line dedup (native): hash blocks of normalised lines, pigeonhole, edit similarity, connected groups.

A line is normalised to lower-case words of letters and digits. Lines with the same normal form are equal, if they have
``LEAST_WORDS`` words or ``LEAST_CHARS`` characters; different forms of LEAST_WORDS words or more are linked if they are candidates
and their edit similarity is ``SIMILAR`` or more. Of each connected group the first line by (doc_id, line) stays.

In a SimHash whose bits all sum over all words, one changed word of a short line moves a quarter of the bits, and blocks that
agree are left to chance: few similar lines are found. So here each word is dealt to one block by its hash and moves that
block's bits alone, and a changed word touches two blocks at most: the pigeonhole holds for words. Since blocks are only
asked to be equal, a bit is the parity of its words' bits and not their majority, which tells more lines apart. Of the
five blocks of a line of up to 19 different words any three that agree are a key, and one changed, added or removed word
leaves three alone; of the six of up to 24 words any two, which two changed words leave. Longer lines have more blocks the
more words they have (about five words each, by ``_level``), and one that agrees is a key: the first are kept with the form,
the rest are further rows of it. In lines of up to ``TINY`` words each word is a block and keys are all words
and all but one. A line that a longer one of the next level may be similar to has keys of both, so two lines are compared by
the blocks of the one with more words. README states recall by length.

In each inverted list of several components a pivot is paired with every other member, first the form with the most shared
lists, then one that it did not reach. In lists that are still open the members of different components are paired in
full, in blocks of rows. Texts are not moved: the lines of forms in lists are read again once, and compared first for few
edits and then for as many as the similarity allows: of characters, and of words in lines of more than ``WORDWISE`` characters.

Defined results: null texts have no lines and stay null; blank lines, lines of marks alone and shorter ones always stay; a
null ``doc_id`` comes first in the order; rows that repeat an id and a text are treated as one and stay alike; other
columns are kept by ``dedup`` and clash with nothing; an empty table gives an empty result. Normal forms are named by
64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, extended, let, stage, unstage

SIMILAR = 0.9
LEAST_WORDS, LEAST_CHARS = 3, 16
#: Longer lines are compared by words, which takes a thirtieth of the time.
WORDWISE = 600
#: By level: least words, blocks, and how many of them make a key. From LONG words on blocks grow with the words, level by
#: level by GROWTH, and one is a key; the first KEPT of them are columns of a form.
SHORT = ((0, 5, 3), (20, 6, 2))
LONG, LONG_BLOCKS, GROWTH, KEPT = 25, 6, 1.5, 10
TINY = 8
#: Least characters of words under a key of several blocks and of one block, so that a few common words are none.
LEAST_SEVERAL, LEAST_ONE = 12, 18
#: Levels of lines whose words are blocks, and of lines without keys.
WORDS, NONE = -2, -1
PIVOTS = 2
#: Blocks that members of an open list must agree in to be compared: that of the list and no other one.
TWO = 1
#: Members of a list that one task pairs with all of it.
BLOCK = 256
BROADCAST_IDS = 500_000


def _words(line: Column) -> Column:
    return F.array_remove(F.split(F.lower(line), r"[^\p{L}\p{N}]+"), "")


def _level(n: Column) -> Column:
    out = F.floor(F.log(n / float(LONG)) / math.log(GROWTH) + 1e-9).cast("int") + len(SHORT)
    for k in range(len(SHORT) - 1, -1, -1):
        out = F.when(n < ([least for least, _, _ in SHORT] + [LONG])[k + 1], F.lit(k)).otherwise(out)
    return out


def _n_blocks(level: Column) -> Column:
    out = F.rint(LONG_BLOCKS * F.pow(F.lit(GROWTH), (level - len(SHORT)).cast("double"))).cast("int")
    for k in range(len(SHORT) - 1, -1, -1):
        out = F.when(level <= k, F.lit(SHORT[k][1])).otherwise(out)
    return out


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, row, one, at, ws) of each line; ``row`` names the text, ``one`` keeps rows that repeat both apart."""
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("row"), F.monotonically_increasing_id().alias("one"), "text")
    rows = rows.select("doc_id", "row", "one", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    return rows.select("doc_id", "row", "one", "at", _words(F.col("line")).alias("ws"))


def line_table(docs: DataFrame) -> DataFrame:
    """(doc_id, row, at, id, n, nw, level, chunk, b0, c0, ...) of each line that may go, for each of its levels and each KEPT of
    its blocks: ``id`` names the normal form, ``n`` and ``nw`` are its characters and different words, b0 is the first block of
    the chunk and c0 the characters of its words."""
    rows = _lines(docs).select("doc_id", "row", "one", "at", F.array_distinct("ws").alias("ws"), F.xxhash64("ws").alias("id"), F.length(F.array_join("ws", " ")).alias("n"))
    rows = rows.withColumn("nw", F.size("ws"))
    # No rows for lines that always stay: a filter would be moved below the words and make them twice.
    exact = F.when(F.col("n") >= LEAST_CHARS, F.array(F.lit(NONE))).otherwise(F.array().cast("array<int>"))
    tiny = F.when(F.col("nw") < TINY, F.array(F.lit(WORDS))).otherwise(F.array(F.lit(WORDS), F.lit(0)))
    levels = F.array_distinct(F.array(_level(F.col("nw")), _level(F.floor(F.col("nw") / SIMILAR))))
    levels = F.when(F.col("nw") < LEAST_WORDS, exact).when(F.col("nw") <= TINY, tiny).otherwise(levels)
    keys = ["doc_id", "row", "at", "id", "n", "nw", "level"]
    of_level = F.transform(levels, lambda x: F.struct(x.alias("level"), _n_blocks(x).alias("n_blocks")))  # once a line, not a word
    rows = rows.select("one", *keys[:-1], "ws", F.explode(of_level).alias("l")).select("one", *keys[:-1], "l.*", F.posexplode("ws").alias("i", "w"))
    rows = rows.select("one", *keys, "n_blocks", "i", F.xxhash64("w").alias("h"), F.length("w").alias("chars"))
    rows = rows.withColumn("k", F.when(F.col("level") == WORDS, F.col("i")).otherwise(F.pmod(F.hash("h"), F.col("n_blocks"))))
    rows = rows.withColumn("chunk", F.floor(F.col("k") / KEPT).cast("int")).withColumn("k", F.col("k") % KEPT)
    bits = [F.bit_xor(F.when(F.col("k") == b, F.col("h")).otherwise(F.lit(0).cast("long"))).alias(f"b{b}") for b in range(KEPT)]
    sizes = [F.sum(F.when(F.col("k") == b, F.col("chars")).otherwise(F.lit(0))).cast("int").alias(f"c{b}") for b in range(KEPT)]
    return rows.groupBy("one", *keys, "chunk").agg(*bits, *sizes).drop("one")


def forms(lines: DataFrame) -> DataFrame:
    """(id, level, n, nw, b0, c0, ..., more, first_at) of the distinct normal forms, for each level: the first KEPT blocks and
    the keys of those beyond them."""
    first = lambda x: F.max(F.when(F.col("chunk") == 0, F.col(x))).alias(x)
    some = lambda x: F.coalesce(first(x), F.lit(0)).alias(x)  # noqa: E731  none of a long line's words may be in its first blocks
    blocks = [some(x) for x in (*(f"b{b}" for b in range(KEPT)), *(f"c{b}" for b in range(KEPT)))]
    more = F.array_distinct(F.flatten(F.collect_set(F.when(F.col("chunk") > 0, _long_keys(F.col("chunk")))))).alias("more")
    return lines.groupBy("id", "level").agg(F.max("n").alias("n"), F.max("nw").alias("nw"), *blocks, more, F.min(_where()).alias("first_at"))


def _where() -> Column:
    return F.struct(F.col("doc_id"), F.col("row"), F.col("at"))


def _key(blocks: Sequence[int], chunk: Column | None = None) -> Column:
    under = sum((F.col(f"c{b}") for b in blocks[1:]), F.col(f"c{blocks[0]}"))
    names = [F.lit(b) if chunk is None else chunk * KEPT + b for b in blocks]
    return F.when(under >= (LEAST_SEVERAL if len(blocks) > 1 else LEAST_ONE), F.xxhash64("level", *names, *(f"b{b}" for b in blocks)))


def _long_keys(chunk: Column) -> Column:
    return F.array_compact(F.array(*(_key([b], chunk) for b in range(KEPT))))


def keys(known: DataFrame) -> DataFrame:
    """(key, x, n) of each list that a form is in, of forms or of lines."""
    ws = F.sort_array(F.slice(F.array(*(f"b{b}" for b in range(TINY))), 1, F.least("nw", F.lit(TINY))))
    but_one = F.transform(ws, lambda _, i: F.xxhash64("level", F.filter(ws, lambda _, j: i != j)))
    tiny = F.array_distinct(F.concat(F.array(F.xxhash64("level", ws)), but_one))
    long = _long_keys(F.col("chunk")) if "chunk" in known.columns else F.concat(_long_keys(F.lit(0)), "more")
    every = F.when(F.col("level") == WORDS, tiny).when(F.col("level") >= len(SHORT), long)
    for k, (_, blocks, few) in enumerate(SHORT):
        every = every.when(F.col("level") == k, F.array_compact(F.array(*(_key(c) for c in combinations(range(blocks), few)))))
    return known.select(F.explode(every).alias("key"), F.col("id").alias("x"), "n")


def _listed(keyed: DataFrame) -> DataFrame:
    """The members of lists of two forms or more: those with another one beside them, so that keys are moved once."""
    order = Window.partitionBy("key").orderBy("x")
    beside = [F.coalesce(f("x").over(order) != F.col("x"), F.lit(False)) for f in (F.lag, F.lead)]
    return keyed.withColumn("several", beside[0] | beside[1]).where("several").drop("several")


def _lengths_fit(a: Column, b: Column) -> Column:
    return F.least(a, b) >= F.lit(SIMILAR) * F.greatest(a, b)


def _named(members: DataFrame, comps: DataFrame) -> DataFrame:
    """Members of lists of several components, named anew; ``done`` marks those that are with a pivot so far."""
    named = comps.withColumnsRenamed({"node": "x", "component": "now"})
    members = members.join(named, "x", "left").withColumn("c", F.coalesce("now", "x")).drop("now")
    lists = members.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.max_by("c", F.struct(F.col("x") == F.col("p"), "x")).alias("with"))
    members = members.join(lists.where(F.col("low") < F.col("high")).select("key", "with"), "key")
    return members.select("key", "x", "n", "shared", "c", (F.col("done") | (F.col("c") == F.col("with"))).alias("done"))


def _in_full(members: DataFrame, known: DataFrame) -> DataFrame:
    """(p, x): the pairs of different components in each list, in blocks of rows, whose lengths fit. Lines with one block a
    key are paired in the list of the first of the blocks in ``known`` that makes a key of both; in lists of further blocks,
    and of a level that is not the lines' last, whatever else they share."""
    sized = members.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    names, sizes = [f"b{b}" for b in range(KEPT)], [f"c{b}" for b in range(KEPT)]
    own = known.where(F.col("level") != NONE).groupBy(F.col("id").alias("x")).agg(F.max_by(F.struct("level", *names, *sizes), "level").alias("s"))
    rows = members.join(sized, "key").join(own, "x").select("key", "blocks", "x", "n", "c", "s.*")
    rows = stage(rows.withColumn("at", F.array_position(F.array(*(F.xxhash64("level", F.lit(k), f"b{k}") for k in range(KEPT))), F.col("key")) - 1), "open-lists")
    kept = ["x", "n", "c", "level", *names]
    a = rows.select("key", F.pmod(F.xxhash64("x"), F.col("blocks")).cast("int").alias("block"), *(F.col(k).alias(f"p_{k}") for k in kept))
    b = rows.select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "at", *kept, *sizes)
    same = [(F.col(f"p_{k}") == F.col(k)) & (F.col(k) != 0) for k in names]
    equal = sum((x.cast("int") for x in same), F.lit(0))
    before = F.lit(False)
    for k in range(KEPT - 1):
        before = before | ((F.col("at") > k) & same[k] & (F.col(f"c{k}") >= LEAST_ONE))
    alike = (F.col("p_level") != F.col("level")) | (F.col("level") < len(SHORT)) | (F.col("at") < 0) | ((equal >= TWO) & ~before)
    fits = (F.col("p_c") != F.col("c")) & (F.col("p_x") < F.col("x")) & _lengths_fit(F.col("p_n"), F.col("n")) & alike
    pairs = stage(a.join(b, ["key", "block"]).where(fits).select(F.col("p_x").alias("p"), "x").distinct(), "line-pairs")
    unstage(rows)
    return pairs


def links(known: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, component) of linked forms. Of lines, forms are made of those in lists alone."""
    listed = stage(_listed(keys(known)), "line-lists")
    central = stage(listed.groupBy("x").agg(F.count("*").alias("shared")), "listed-lines")
    if "first_at" not in known.columns:
        known = stage(forms(known.join(central.select(F.col("x").alias("id")), "id", "left_semi")), "forms")
    texts = stage(_texts(central.select("x"), known, docs), "line-texts")
    members = stage(listed.join(central, "x").select("key", "x", "n", "shared", F.col("x").alias("c"), F.lit(False).alias("done")), "line-lists")
    unstage(listed, central)
    comps = None
    for _ in range(PIVOTS):
        order = F.struct((~F.col("done")).alias("new"), "shared", "x")
        pivots = members.groupBy("key").agg(F.max_by(F.struct(F.col("x").alias("p"), F.col("n").alias("p_n"), F.col("c").alias("p_c")), order).alias("pivot"))
        both = stage(members.join(pivots.select("key", "pivot.*"), "key"), "line-lists")
        fit = both.where((F.col("c") != F.col("p_c")) & _lengths_fit(F.col("n"), F.col("p_n")))
        pairs = stage(fit.select(F.least("p", "x").alias("p"), F.greatest("p", "x").alias("x")).distinct(), "line-pairs")
        found = stage(_verified(pairs, texts), "line-links")
        comps = stage(components(found) if comps is None else extended(comps, found), "line-groups")
        after = stage(_named(both, comps), "line-lists")
        unstage(members, both, pairs)
        members = after
    if not members.isEmpty():
        pairs = _in_full(members, known)
        comps = stage(extended(comps, stage(_verified(pairs, texts), "line-links")), "line-groups")
        unstage(pairs)
    unstage(members, texts)
    return comps


def _texts(wanted: DataFrame, known: DataFrame, docs: DataFrame) -> DataFrame:
    """(x, norm): the normal forms of the wanted ids, read again where they stand first."""
    at = known.join(wanted, known["id"] == wanted["x"], "left_semi").select("id", "first_at.row", "first_at.at").distinct()
    at = stage(at, "line-places")
    per_text = at.groupBy(F.col("row").alias("r")).agg(F.collect_set(F.struct("at", "id")).alias("ls"))
    if at.count() <= BROADCAST_IDS:  # 32 bytes each; more of them are joined by a shuffle
        per_text = F.broadcast(per_text)
    found = docs.select(F.xxhash64("text").alias("row"), "text").join(per_text, F.col("row") == F.col("r"))
    found = found.select(F.split("text", "\n").alias("lines"), F.explode("ls").alias("l"))
    return found.select(F.col("l.id").alias("x"), F.array_join(_words(F.get("lines", F.col("l.at"))), " ").alias("norm")).dropDuplicates(["x"])


def _few_words(a: Column, b: Column, most: Column) -> Column:
    """Whether two lines are alike but for words in the same places, or for one run of words, of no more characters than
    ``most``: then so many edits are enough. Tells in one pass, where edit distances take as many as there are edits."""
    cost = lambda x: F.coalesce(F.length(x), F.lit(-1)) + 1
    either = lambda x, y: F.when(x.eqNullSafe(y), F.lit(0)).otherwise(F.greatest(cost(x), cost(y)))
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda t, x: t + x)

    def of(pair: Column) -> Column:
        x, y = pair["x"], pair["y"]
        differ = F.zip_with(x, y, lambda p, q: ~p.eqNullSafe(q))
        before = F.array_position(differ, True)
        behind = F.array_position(F.zip_with(F.reverse(x), F.reverse(y), lambda p, q: ~p.eqNullSafe(q)), True)
        inner = lambda ws: total(F.transform(F.slice(ws, before.cast("int"), F.greatest(F.size(ws) - (before + behind).cast("int") + 2, F.lit(0))), cost))
        one_run = F.greatest(inner(x), inner(y)) <= most
        return F.when(F.size(x) == F.size(y), total(F.zip_with(x, y, either)) <= most).otherwise(one_run)

    return let(F.struct(F.split(a, " ").alias("x"), F.split(b, " ").alias("y")), of)


def _word_letters(norm: Column) -> Column:
    """A line with a letter for each word: edits of it are those of words."""
    code = lambda w: F.lpad(F.hex(F.xxhash64(w).bitwiseAND(F.lit(0x7FFF))), 4, "0")
    return F.decode(F.unhex(F.array_join(F.transform(F.split(norm, " "), code), "")), "UTF-16BE")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): the pairs whose edit similarity is high enough: of characters, and of words in lines of more than WORDWISE
    characters. Time grows with the edits that are allowed, so few are tried first."""
    both = pairs.join(texts.select("x", F.col("norm").alias("b")), "x").join(texts.select(F.col("x").alias("p"), F.col("norm").alias("a")), "p")
    longer = F.greatest(F.length("a"), F.length("b"))
    most = lambda n: F.floor((1 - SIMILAR) * n + 1e-9).cast("int")
    near = F.when(_few_words(F.col("a"), F.col("b"), most(longer)), True)
    both = both.select("p", "x", near.alias("near"), *(F.when(longer > WORDWISE, _word_letters(F.col(c))).otherwise(F.col(c)).alias(c) for c in "ab"))
    both = both.withColumn("most", most(F.greatest(F.length("a"), F.length("b"))))
    within = lambda k: F.expr(f"levenshtein(a, b, least({k}, most)) >= 0")
    similar = F.when(F.col("near"), True).when(within(16), True).when(F.col("most") <= 16, False).otherwise(within("most"))
    return both.where(similar).select(F.col("p").alias("a"), F.col("x").alias("b"))


def _once(lines: DataFrame, ids: DataFrame) -> DataFrame:
    """The lines that stand first of their form."""
    again = ids.where(F.col("first_at") < F.col("last_at")).select("id", "first_at")
    if again.count() <= BROADCAST_IDS:  # about 60 bytes each
        again = F.broadcast(again)
    return lines.join(again, "id", "left").where(F.coalesce(F.col("first_at") == _where(), F.lit(True))).select(*lines.columns)


def extra_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, row, gone): the numbers of the lines that an earlier line of their group makes superfluous."""
    seen = stage(line_table(docs), "lines")
    ids = stage(seen.groupBy("id").agg(F.min(_where()).alias("first_at"), F.max(_where()).alias("last_at")), "line-ids")
    comps = links(_once(seen, ids), docs)
    several = ids.join(comps.withColumnsRenamed({"node": "id"}), "id", "left")
    several = several.select("id", F.coalesce("component", "id").alias("g"), "first_at", "last_at")
    groups = several.groupBy("g").agg(F.min("first_at").alias("first"), F.max("last_at").alias("last"))
    firsts = several.select("id", "g").join(groups.where(F.col("first") < F.col("last")), "g").select("id", "first")
    gone = seen.select("doc_id", "row", "at", "id").join(firsts, "id").where(_where() != F.col("first"))
    out = stage(gone.groupBy("doc_id", "row").agg(F.array_sort(F.collect_set("at")).alias("gone")), "extra-lines")
    unstage(ids, seen)
    return out


def dedup(docs: DataFrame) -> DataFrame:
    """The documents with ``text`` less its superfluous lines and ``n_chars`` counted anew where there is one; other
    columns as they were."""
    gone = extra_lines(docs).select(F.col("doc_id").alias("__id"), F.col("row").alias("__row"), F.col("gone").alias("__gone"))
    if gone.count() <= BROADCAST_IDS:  # about 50 bytes each; with more of them texts are dealt by id
        gone = F.broadcast(gone)
    both = docs.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__row")), "left")
    left = F.filter(F.split("text", "\n"), lambda _, k: ~F.array_contains("__gone", k))
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    out = both.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__gone").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*docs.columns, F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("__n_gone"))


def digest(docs: DataFrame, columns: Sequence[str] = ("doc_id", "text")) -> DataFrame:
    out = dedup(docs.select(*columns))
    return out.select(*columns, F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines_kept"), F.col("__n_gone").alias("n_lines_gone"))
