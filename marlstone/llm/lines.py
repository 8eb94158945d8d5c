"""Line deduplication by an exact set-similarity join, in DataFrame functions only.

A line's tokens are its distinct five-word shingles (words are cut at ASCII white space, and case counts); a line of one
to four words has one token, of all its words. Two lines match if the Jaccard similarity of their tokens is at least
PERCENT / 100; a line goes if it matches an earlier one. Lines are ordered by document id and place.

1. Tokens are counted in a table of SLOTS slots, whatever the size of the corpus; a token's rarity is the rank of its
   slot's count among all slots, in 126 classes, and ties fall by hash. Any total order is exact; rare tokens first keep
   candidates few.
2. Lines with equal token sets are one node, whose place is that of its first line; all but the first go.
3. Prefix filter: matching sets share one of their first m - ceil(PERCENT * m / 100) + 1 tokens. Only tokens that two
   nodes have in their prefixes are looked at further. Sets too small to match any but an equal one have no prefix.
4. Each node meets the earliest node, and the one with the most lines, of each of its prefix tokens: rows in proportion
   to nodes, which settles nearly all lines of large groups of near copies. Nodes without an earlier match are then
   joined with all earlier nodes that share a prefix token. Length and positional filters apply to both joins.
5. Full token sets, read again from the texts, verify each candidate pair.
6. Lines look up what became of their node; nodes of very many lines are salted for that.

Tokens are told apart by 56 bits of a hash, and sets by 96 bits of two: a line goes only if both hashes of its set are
those of the first line's. Null texts have no lines, and come out null; rows with equal id and text come out alike, and
their lines do not match each other; rows without an id come last; ids are whole numbers. Of matching lines at equal
places (rows that share an id) the one with the lesser text hash comes first. Lines without a word stay. Texts of any
length are taken whole. An empty table gives an empty result. All columns of the input are kept, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Members, fresh, stored, table

WORDS, PERCENT, SLOTS, LAST = 5, 80, 1 << 16, (1 << 63) - 1
#: Nodes of more lines are salted, over so many keys.
MANY, SALTS = 1_000, 64
_LOW = (1 << 56) - 1


def words_of(line: Column) -> Column:
    """Runs of other characters than ASCII white space."""
    odd = line.contains("  ") | line.contains("\t") | line.contains("\r") | line.contains("\x0b") | line.contains("\x0c") | line.startswith(" ") | line.endswith(" ")
    return F.when(odd, F.filter(F.split(line, r"[\x20\x09-\x0D]+"), lambda w: w != "")).otherwise(F.split(line, " "))


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, h, no, line) of each line that isn't empty; ids as order keys, the missing one last."""
    text = docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(LAST)).alias("id"), docs[text_col].alias("text")).where("text is not null")
    lines = text.select("id", F.xxhash64("text").alias("h"), F.posexplode(F.split("text", "\n")).alias("no", "line"))
    return lines.where("line <> ''")


def hashed(lines: DataFrame, *keep: str) -> DataFrame:
    """(kept columns, w): the hash of each word."""
    return lines.select(*keep, F.transform(words_of(F.col("line")), lambda w: F.xxhash64(w)).alias("w"))


def starts(w: Column) -> Column:
    """Where tokens begin: at each word that WORDS - 1 others follow, or at the first of fewer."""
    return F.when(F.size(w) > 0, F.sequence(F.lit(0), F.greatest(F.size(w) - WORDS, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def token(w: Column, i: Column) -> Column:
    """56 bits of the hash of the words from ``i`` on; words that aren't there are left out."""
    return F.xxhash64(*[F.get(w, i + k) for k in range(WORDS)]).bitwiseAND(F.lit(_LOW))


def ranked(lines: DataFrame, classes: bytes) -> DataFrame:
    """Lines with their distinct tokens t, the rarity in the upper byte, in order."""
    keep = [c for c in lines.columns if c != "line"]
    w = F.col("w")
    # no filter by size here: it would be pushed below and work the hashes out a second time
    tokens = hashed(lines, *keep).select(*keep, F.transform(starts(w), lambda i: token(w, i)).alias("t"))
    slot = lambda x: F.ascii(F.substring(F.lit(classes), F.pmod(x, F.lit(SLOTS)).cast("int") + 1, 1).cast("string")).cast("long")
    return tokens.select(*keep, F.sort_array(F.array_distinct(F.transform("t", lambda x: F.shiftleft(slot(x), 56).bitwiseOR(x)))).alias("t"))


def rarity(lines: DataFrame) -> bytes:
    """A byte for each slot, its class: SLOTS rows at most come to the driver, and go into the plan."""
    # explode_outer: a filter inferred from explode would be pushed below and work the hashes out anew for each shingle
    at = hashed(lines).select("w", F.explode_outer(starts(F.col("w"))).alias("i")).where("i is not null")
    slot = F.pmod(token(F.col("w"), F.col("i")), F.lit(SLOTS)).cast("int")
    slots = at.groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n")).toArrow()
    counts = np.zeros(SLOTS, np.int64)
    counts[slots.column("slot").to_numpy()] = slots.column("n").to_numpy()
    rank = np.searchsorted(np.sort(counts), counts)
    return (1 + rank * 126 // SLOTS).astype(np.uint8).tobytes()


def least_overlap(a: Column, b: Column) -> Column:
    """The least number of common tokens of matching sets of these sizes."""
    return F.ceil(F.lit(PERCENT) * (a + b) / F.lit(100 + PERCENT))


def may_match(x: str, y: str) -> Column:
    """Length and positional filters for a common prefix token at x.i and y.i (from 0)."""
    a, b, i, j = (F.col(f"{s}.{c}") for c in ("m", "i") for s in (x, y))
    return (F.lit(100) * F.least(a, b) >= F.lit(PERCENT) * F.greatest(a, b)) & (F.lit(1) + F.least(a - i - 1, b - j - 1) >= least_overlap(a, b))


def pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(x, at_x, y, at_y): nodes of ``right`` with earlier ones of ``left`` that share a prefix token and may match."""
    cond = (F.col("x.token") == F.col("y.token")) & (F.col("x.at") < F.col("y.at")) & may_match("x", "y")
    return left.alias("x").join(right.alias("y"), cond).select(F.col("x.s").alias("x"), F.col("x.at").alias("at_x"), F.col("y.s").alias("y"), F.col("y.at").alias("at_y")).distinct()


def sets_of(docs: DataFrame, wanted: DataFrame, classes: bytes, id_col: str, text_col: str) -> DataFrame:
    """(s, t): full token sets of the nodes ``wanted`` (s, at), from their first lines. Lines are found by a filter, so
    that texts stay where they are; what it lets through in error is another node, or the same again."""
    place = lambda *c: F.xxhash64(*c)
    found = Members(stored(wanted.select(place("at.id", "at.h", "at.no").alias("k")), "line-places"))
    lines = lines_of(docs, id_col, text_col).where(found.maybe(place("id", "h", "no")))
    sets = ranked(lines.select("line"), classes).select(F.xxhash64("t").alias("s"), "t")
    return stored(sets.join(wanted.select("s").hint("shuffle_hash"), "s", "left_semi").dropDuplicates(["s"]), "line-sets")


def verified(found: DataFrame, sets: DataFrame) -> DataFrame:
    """Of ``found`` (x, y), the y of those that match."""
    a, b = sets.select(F.col("s").alias("x"), F.col("t").alias("tx")), sets.select(F.col("s").alias("y"), F.col("t").alias("ty"))
    both = F.size(F.array_intersect("tx", "ty"))
    return found.select("x", "y").join(a, "x").join(b, "y").where(F.lit(100 + PERCENT) * both >= F.lit(PERCENT) * (F.size("tx") + F.size("ty"))).select("y").distinct()


def nodes_of(found: DataFrame) -> DataFrame:
    return found.select(F.explode(F.array(F.struct(F.col("x").alias("s"), F.col("at_x").alias("at")), F.struct(F.col("y").alias("s"), F.col("at_y").alias("at")))).alias("n")).select("n.*").distinct()


def matched(docs: DataFrame, own: DataFrame, classes: bytes, id_col: str, text_col: str) -> DataFrame:
    """(y): nodes that match an earlier one, of the lines ``own`` (id, h, no, s, m, p)."""
    every = own.where(F.size("p") > 0)
    twice = every.select("s", F.explode("p").alias("token")).groupBy("token").agg(F.min("s").alias("a"), F.max("s").alias("b")).where("a <> b").select("token")
    twice = stored(twice, "line-tokens")
    rows = every.select("s", "m", F.struct("id", "h", "no").alias("at"), F.posexplode("p").alias("i", "token")).where(Members(twice).maybe(F.col("token")))
    rows = rows.groupBy("token", "s", "i", "m").agg(F.min("at").alias("at"), F.count(F.lit(1)).alias("lines"))
    shared = stored(rows.join(twice, "token", "left_semi"), "line-shared")
    node = F.struct("s", "at", "m", "i")
    heads = shared.groupBy("token").agg(F.min_by(node, F.col("at")).alias("e"), F.max_by(node, F.struct("lines", F.col("s"))).alias("f"))
    heads = heads.select("token", F.explode(F.array_distinct(F.array("e", "f"))).alias("x")).select("token", "x.*")
    found = stored(pairs(heads, shared), "line-pairs")
    sets = sets_of(docs, nodes_of(found), classes, id_col, text_col)
    first = stored(verified(found, sets), "line-matched")
    rest = shared.join(first.select(F.col("y").alias("s")), "s", "left_anti")
    more = stored(pairs(shared, rest).join(found.select("x", "y"), ["x", "y"], "left_anti"), "line-pairs")
    others = sets_of(docs, nodes_of(more).join(sets, "s", "left_anti"), classes, id_col, text_col)
    return stored(first.unionByName(verified(more, sets.unionByName(others))), "line-matched")


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, h, gone): the places of the lines that go, for each id (missing: last) and text hash that loses any."""
    lines = lines_of(docs, id_col, text_col)
    classes = rarity(lines)
    m = F.size("t")
    prefix = F.when(100 * m >= PERCENT * (m + 1), F.slice("t", 1, m - F.ceil(F.lit(PERCENT) * m / 100).cast("int") + 1)).otherwise(F.array().cast("array<bigint>"))
    every = ranked(lines, classes).select("id", "h", "no", F.xxhash64("t").alias("s"), F.hash("t").alias("s2"), m.alias("m"), prefix.alias("p"))
    own = stored(every, "line-prefixes").where("m > 0")
    later = matched(docs, own, classes, id_col, text_col).select(F.col("y").alias("s"), F.lit(True).alias("later"))
    place = F.struct("id", "h", "no")
    firsts = own.groupBy("s").agg(F.min(F.struct("id", "h", "no", "s2")).alias("first"), F.count(F.lit(1)).alias("lines"))
    firsts = stored(firsts.join(later, "s", "left").where("later or lines > 1"), "line-nodes")
    some, large = (Members(stored(x, "line-keys")) for x in (firsts.select("s"), firsts.where(F.col("lines") > MANY).select("s")))
    heavy = large.maybe(F.col("s"))
    every_salt = F.when(heavy, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    known = firsts.select("s", "first", F.coalesce("later", F.lit(False)).alias("later"), F.explode(every_salt).alias("salt"))
    salted = own.where(some.maybe(F.col("s"))).select("id", "h", "no", "s", "s2", F.when(heavy, F.pmod(F.xxhash64("id", "h", "no"), F.lit(SALTS)).cast("int")).otherwise(0).alias("salt"))
    same = F.col("s2") == F.col("first.s2")
    again = place != F.struct("first.id", "first.h", "first.no")
    lost = salted.join(known.hint("shuffle_hash"), ["s", "salt"]).where(same & (F.col("later") | again))
    return lost.groupBy("id", "h").agg(F.sort_array(F.collect_set("no")).alias("gone"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str = "n_lines", gone_col: str = "gone") -> DataFrame:
    """All rows and columns of ``docs``, with later matches cut from the text, and the number of lines and the places
    (from 0) of those that went in two columns after them. If ``docs`` has a column of either name, its own is kept and
    neither is added: give other names to have them."""
    i_col, t_col, id_key, h_key, gone = (fresh(docs, c) for c in ("__i", "__t", "__id", "__h", "__gone"))
    lost = stored(removals(docs, id_col, text_col), "line-removals").select(F.col("id").alias(id_key), F.col("h").alias(h_key), F.col("gone").alias(gone))
    keyed = docs.withColumns({i_col: F.coalesce(docs[id_col].cast("long"), F.lit(LAST)), t_col: F.xxhash64(docs[text_col])})
    some = Members(stored(lost.select(F.xxhash64(id_key, h_key).alias("k")), "line-keys")).maybe(F.xxhash64(i_col, t_col))  # only documents that may lose a line are dealt out for the join
    found = keyed.where(some).join(lost.hint("shuffle_hash"), (F.col(i_col) == F.col(id_key)) & (F.col(t_col) == F.col(h_key)) & F.col(text_col).isNotNull(), "left")
    found = found.unionByName(keyed.where(~some), allowMissingColumns=True)
    lines = F.split(F.col(text_col), "\n")
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(gone, i)), "\n")
    cols = [F.when(F.col(gone).isNull(), F.col(c)).otherwise(kept).alias(c) if c == text_col else F.col(c) for c in docs.columns]
    if {count_col.lower(), gone_col.lower()} & {c.lower() for c in docs.columns}:
        return found.select(*cols)
    return found.select(*cols, F.coalesce(F.size(lines), F.lit(0)).alias(count_col), F.coalesce(gone, F.array().cast("array<int>")).alias(gone_col))


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup(docs).select("doc_id", "n_lines", F.size("gone").alias("n_removed"), F.col("gone").alias("removed"), "text")
