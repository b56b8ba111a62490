"""Links spellings of one entity: suffix blocking refined by other fields, comparison by longest common subsequence, components.

A name form is one folded name in one block (place and day), whatever ids use it. Two forms are candidates when they are of one block and share
a suffix of a word and the beginning or end of another word; where one of them has a single full word, the suffix alone. This holds at
every size: blocks of few forms are paired where they are, larger ones through an index of hashed keys, and a key that many forms hold is
compared in square tiles of bounded size, so no holder and no link is dropped and no task gathers an unbounded group.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SPACES, is_missing, letters_and_digits
from ..operators.hot import hot_keys
from ..session import checkpoint, written
from .namematch import LEGAL, NICKNAMES, TITLES, model_numbers, same_model, same_name
from .similar import memo

SUFFIX = 4  # shortest suffix that is indexed
TILE = 64  # forms that are paired at a time
HOT_ROWS = 100_000  # rows from which a block may be handled apart
MANY_WORDS = 6  # words beyond which only words side by side make a key


def _accents() -> tuple[str, str]:
    """Letters with accents and their plain letters, by the decomposition rule of Unicode."""
    pairs = [(chr(i), unicodedata.normalize("NFKD", chr(i))[0]) for i in range(0xC0, 0x250) if unicodedata.normalize("NFKD", chr(i))[0] != chr(i)]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def words(name: Column) -> Column:
    """The folded words of a name without titles and legal forms, each as it sounds, with all full names of short forms beside them (a|b); initials are left out."""
    a, b = _accents()
    low = F.lower(name)
    ascii_only = F.octet_length(low) == F.length(low)
    m_s = lambda x: F.replace(x, F.lit("m/s "), F.lit(" "))
    plain = F.regexp_replace(m_s(F.replace(low, F.lit("'"), F.lit(""))), "[^a-z0-9]+", " ")
    other = F.regexp_replace(m_s(F.translate(low, a + "'’", b)), r"[^\p{L}\p{N}]+", " ")  # letters without counterpart go
    text = F.when(ascii_only, plain).otherwise(other)
    parts = F.filter(F.split(text, " "), lambda w: (F.length(w) > 1) & ~w.isin(*TITLES, *LEGAL))
    full = F.expr("map(" + ", ".join(f"'{n}', '{'|'.join([n, *names.split()])}'" for n, names in NICKNAMES.items()) + ")")
    parts = F.transform(parts, lambda w: F.when(w.isin(*NICKNAMES), F.try_element_at(full, w)).otherwise(w))  # the set is hashed, the map is not
    joined = F.array_join(parts, " ")
    for x, y in (("ph", "f"), ("ee", "i"), ("oo", "u"), ("dh", "d"), ("th", "t")):
        joined = F.replace(joined, F.lit(x), F.lit(y))
    joined = F.regexp_replace(F.translate(joined, "qcwyz", "kkvis"), r"([a-z])\1+", "$1")
    return F.filter(F.split(joined, " "), lambda w: w != "")


def suffixes(forms: Column) -> Column:
    """Hashed suffix keys of a word's forms: the suffix of each, and that of the form without its last letter, as a letter may be missing or too many at the end."""
    tail = lambda w, k: F.hash(F.substr(w, F.length(w) - F.lit(SUFFIX + k - 1), F.lit(SUFFIX)))
    return F.flatten(F.transform(forms, lambda w: F.when(F.length(w) > SUFFIX, F.array(tail(w, 0), tail(w, 1))).otherwise(F.array(F.hash(w)))))


def ends(forms: Column) -> Column:
    """What refines a key, hashed: beginning and end of each form of a word; of two letters in words of up to eight, of three in those of three and more, so that words one edit apart share one."""
    n = F.length
    end = lambda w, k: F.hash(F.lit(k), F.substr(w, n(w) - F.lit(k - 1)))
    begin = lambda w, k: F.hash(F.lit(-k), F.substring(w, 1, k))
    each = lambda w: F.array(F.when(n(w) <= 8, begin(w, 2)), F.when(n(w) <= 8, end(w, 2)), F.when(n(w) >= 3, begin(w, 3)), F.when(n(w) >= 6, end(w, 3)))
    return F.array_compact(F.flatten(F.transform(forms, each)))


def each_form(ws: Column) -> Column:
    """The forms of each word of `words`."""
    return F.transform(ws, lambda w: F.when(F.contains(w, F.lit("|")), F.split(w, r"\|")).otherwise(F.array(w)))


def keys_of(ws: Column) -> tuple[Column, Column]:
    """Hashed suffixes and ends of each of the `words`."""
    forms = each_form(ws)
    return F.transform(forms, suffixes), F.transform(forms, ends)


def with_keys(forms: DataFrame, name: str) -> DataFrame:
    """forms with `_w` (the full words), `_sa` (their hashed suffixes), `_single` (at most one full word) and `_bits`, the suffixes as a set of 64 bits.

    The ends of words are left to the few pairs that share a suffix.
    """
    out = forms.withColumn("_w", words(F.col(name)))
    out = out.withColumn("_sa", suffixes(F.flatten(each_form(F.col("_w"))))).withColumn("_single", F.size("_w") <= 1)
    bits = F.aggregate("_sa", F.lit(0).cast("bigint"), lambda m, k: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(k, F.lit(64)))))
    return out.withColumn("_bits", bits)


def _others(sb: Column, i: Column) -> Column:
    """Ends of the words beside word i: of all others, in names of more than MANY_WORDS words of those next to it, so that keys grow with the words and not with their square."""
    near = lambda b, j: j != F.least(i, F.lit(1))
    return F.flatten(F.when(F.size(sb) <= MANY_WORDS, F.filter(sb, lambda b, j: j != i)).otherwise(F.filter(F.slice(sb, F.greatest(i, F.lit(1)), F.least(i, F.lit(1)) + 2), near)))


def share_a_suffix(x: Column, y: Column) -> Column:
    """Whether two forms share the suffix of a word. The bits rule most pairs out."""
    return (x["_bits"].bitwiseAND(y["_bits"]) != 0) & F.arrays_overlap(x["_sa"], y["_sa"])


@memo(200_000)
def _word_keys(w: str) -> tuple[frozenset, frozenset]:
    """The same as `suffixes` and `ends` of one of the `words`, not hashed."""
    sa, sb = set(), set()
    for f in w.split("|"):
        sa |= {f[-SUFFIX:], f[-SUFFIX - 1 : -1]} if len(f) > SUFFIX else {f}
        sb |= {(-2, f[:2]), (2, f[-2:])} if len(f) <= 8 else set()
        sb |= {(-3, f[:3])} if len(f) >= 3 else set()
        sb |= {(3, f[-3:])} if len(f) >= 6 else set()
    return frozenset(sa), frozenset(sb)


def share_a_key(x: str, y: str) -> bool:
    """Whether two forms, given by their `words` with spaces between, share the suffix of a word and an end of another; the suffix alone is enough where one of them has a single full word.

    The same as a key in common of `index_keys`, for the pairs of small blocks, of which few need it: a worker remembers the keys of words.
    """
    xs, ys = ([_word_keys(w) for w in t.split(" ") if w] for t in (x, y))
    alone = len(xs) <= 1 or len(ys) <= 1
    beside = lambda ks, i: [k for j, (_, k) in enumerate(ks) if j != i and (len(ks) <= MANY_WORDS or abs(i - j) == 1)]
    for i, (a, _) in enumerate(xs):
        for j, (b, _) in enumerate(ys):
            if not a.isdisjoint(b) and (alone or any(not p.isdisjoint(q) for p in beside(xs, i) for q in beside(ys, j))):
                return True
    return False


def index_keys(ws: Column) -> Column:
    """The same as hashed keys of one form: each suffix with each end of another word."""
    sa, sb = keys_of(ws)
    cross = lambda k: F.flatten(F.transform(k["a"], lambda ks, i: F.flatten(F.transform(ks, lambda x: F.transform(_others(k["b"], i), lambda y: F.xxhash64(x, y))))))
    return F.array_distinct(F.flatten(F.transform(F.array(F.struct(sa.alias("a"), sb.alias("b"))), cross)))


SIDE = ("_form", "_name", "_lo", "_hi")


def _both(a: Column, b: Column) -> list[Column]:
    """The columns of a pair in order of its forms."""
    swap = a["_form"] > b["_form"]
    return [F.when(swap, y[c]).otherwise(x[c]).alias(f"{s}{c}") for s, x, y in (("a", a, b), ("b", b, a)) for c in SIDE]


def packs(forms: DataFrame, tile: int = TILE) -> DataFrame:
    """(_block, _n, _fs): forms (_form, _name, _lo, _hi, _block, _n) with their keys, in lists of about `tile` forms of one block; one list for a block of up to `tile`.

    _n is the number of forms of the block, null for a block of unknown size, whose forms have a list each. Forms alone in their block stay only if several
    identities use them.
    """
    keyed = with_keys(forms.filter(F.coalesce(F.col("_n") > 1, F.lit(True)) | (F.col("_lo") < F.col("_hi"))), "_name")
    one = F.struct(*SIDE, "_single", "_bits", "_sa", "_w")
    part = F.when(F.col("_n") <= tile, 0).otherwise(F.pmod("_form", F.ceil(F.col("_n") / tile)))
    known = keyed.filter(F.col("_n").isNotNull()).groupBy("_block", "_n", part.alias("_part")).agg(F.collect_list(one).alias("_fs")).drop("_part")
    return known.unionByName(keyed.filter(F.col("_n").isNull()).select("_block", "_n", F.array(one).alias("_fs")))


def near_pairs(packed: DataFrame, tile: int = TILE) -> DataFrame:
    """Distinct pairs (a_form < b_form, with name and smallest and largest identity of both) of forms of one block that may share a key, from `packs`.

    Blocks of up to `tile` forms are paired in place, and a_words, b_words hold the words by which `share_a_key` has still to tell; the others by an index
    of hashed keys, where the words are null. A key's holders are laid in tiles of about `tile` by `tile` forms, each of them a group of its own.
    """
    small = packed.filter((F.col("_n") <= tile) & (F.col("_n") > 1))
    x, y = F.col("x"), F.col("y")
    # two plain explosions and a filter without lambdas run as one compiled loop, in which the list is not copied
    near = small.select("_fs", F.explode("_fs").alias("x")).select("x", F.explode("_fs").alias("y")).filter((x["_form"] < y["_form"]) & share_a_suffix(x, y))
    local = near.select(*_both(x, y), F.array_join(x["_w"], " ").alias("a_words"), F.array_join(y["_w"], " ").alias("b_words"))

    large = packed.filter(F.coalesce(F.col("_n") > tile, F.lit(True))).select("_block", F.explode("_fs").alias("f"))
    key = lambda left, *k: F.struct(F.xxhash64("_block", *k).alias("k"), left.alias("left"))
    keys = F.concat(F.transform(index_keys(F.col("f._w")), lambda k: key(F.lit(True), k)), F.transform(F.array_distinct("f._sa"), lambda k: key(F.col("f._single"), k, F.lit(1))))
    index = written(large.select(*[F.col(f"f.{c}") for c in SIDE], F.explode(keys).alias("_k")).select(*SIDE, F.col("_k.k").alias("_k"), F.col("_k.left").alias("_left")))
    held = index.groupBy("_k").agg(F.sum(F.col("_left").cast("bigint")).alias("_nl"), F.count(F.lit(1)).alias("_nr")).filter((F.col("_nl") > 0) & (F.col("_nr") > 1))
    placed = index.join(held, "_k").withColumn("_rows", F.ceil(F.col("_nl") / tile)).withColumn("_cols", F.ceil(F.col("_nr") / tile))
    i, j = F.pmod("_form", F.col("_rows")), F.pmod("_form", F.col("_cols"))
    at = lambda r, c, left, right: F.struct(r.cast("bigint").alias("r"), c.cast("bigint").alias("c"), F.lit(left).alias("left"), F.lit(right).alias("right"))
    as_left = F.when(F.col("_left"), F.transform(F.sequence(F.lit(0), F.col("_cols") - 1), lambda c: at(i, c, True, False))).otherwise(F.array().cast("array<struct<r:bigint,c:bigint,left:boolean,right:boolean>>"))
    as_right = F.transform(F.sequence(F.lit(0), F.col("_rows") - 1), lambda r: at(r, j, False, True))
    lone = (F.col("_rows") == 1) & (F.col("_cols") == 1) & F.col("_left")
    tiles = F.when(lone, F.array(at(F.lit(0), F.lit(0), True, True))).otherwise(F.concat(as_left, as_right))
    placed = placed.select("_k", F.struct(*SIDE).alias("f"), F.explode(tiles).alias("t"))
    groups = placed.groupBy("_k", "t.r", "t.c").agg(F.collect_list(F.when(F.col("t.left"), F.col("f"))).alias("_ls"), F.collect_list(F.when(F.col("t.right"), F.col("f"))).alias("_rs"))
    crossed = groups.select("_rs", F.explode("_ls").alias("x"))
    crossed = crossed.select("x", F.explode(F.filter("_rs", lambda y: y["_form"] != F.col("x")["_form"])).alias("y")).select(*_both(F.col("x"), F.col("y")))
    return local.unionByName(crossed.dropDuplicates(["a_form", "b_form"]), allowMissingColumns=True)


def _judge(same: Callable[[str, str], bool]) -> Callable[..., Column]:
    """Of names and words of a pair: whether it shares a key, if its words are given, and `same` accepts it. In Arrow batches."""

    @F.pandas_udf("boolean")
    def judge(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for x, y, v, w in batches:
            yield pd.Series([(not isinstance(s, str) or share_a_key(s, t)) and same(p, q) for p, q, s, t in zip(x, y, v, w, strict=True)], dtype=bool)

    return judge


def candidate_pairs(packed: DataFrame, tile: int = TILE) -> DataFrame:
    """The `near_pairs` that share a key."""
    return near_pairs(packed, tile).filter(_judge(lambda x, y: True)("a_name", "b_name", "a_words", "b_words")).drop("a_words", "b_words")


def accepted(pairs: DataFrame, same: Callable[[str, str], bool]) -> DataFrame:
    """The `near_pairs` (a, b) with more than one identity that share a key and that `same` accepts."""
    several = F.least("a_lo", "b_lo") < F.greatest("a_hi", "b_hi")
    return pairs.filter(several).filter(_judge(same)("a_name", "b_name", "a_words", "b_words")).select(F.col("a_form").alias("a"), F.col("b_form").alias("b"))


def components(edges: DataFrame, rounds: int = 30) -> DataFrame:
    """(node, entity): the smallest node reachable over edges (a, b). Labels travel both ways and jump over labels, until none changes."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = checkpoint(both)
    labels = checkpoint(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("entity")))
    for _ in range(rounds):
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("entity").alias("_n"))
        moved = labels.join(near, F.col("node") == F.col("a"), "left").select("node", F.least("entity", "_n").alias("_e"), "entity")
        jump = labels.select(F.col("node").alias("_j"), F.col("entity").alias("_je"))
        new = checkpoint(moved.join(jump, F.col("_e") == F.col("_j"), "left").select("node", F.least("_e", "_je").alias("entity"), (F.least("_e", "_je") != F.col("entity")).alias("_moved")))
        labels = new.select("node", "entity")
        if not new.filter("_moved").limit(1).count():
            return labels
    raise RuntimeError(f"components still change after {rounds} rounds")


def day(c: Column) -> Column:
    """A typed date in one notation (year-month-day; two-digit years are of this century), other text folded, missing as null."""
    s = F.regexp_replace(F.trim(c), rf"^{SPACES}+|{SPACES}+$", "")
    ymd = F.regexp_replace(s, r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})$", "$1-$2-$3")
    dmy = F.regexp_replace(ymd, r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})$", "$3-$2-$1")
    short = F.regexp_replace(dmy, r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{2})$", "20$3-$2-$1")
    # a date that is in this notation already needs none of the patterns
    return F.when(c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), c).otherwise(F.when(~is_missing(c), F.lower(short)))


def link(rows: DataFrame, row_id: str, identity: Column, name: Column, block: dict[str, Column], tile: int = TILE, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(row_id, entity, identity): rows whose names mean the same entity within one block, with another identity among them.

    Rows with a missing name, identity or block value link to nothing: the block fields must agree. Rows of equal folded name and block are one
    form and are compared once, however many ids and copies there are; a form of one identity links only to forms of others. Ids of
    forms are 64-bit hashes. Names without any full word link to nothing.
    """
    b = list(block)
    key = letters_and_digits(name)
    base = rows.select(F.col(row_id).alias("_row"), identity.alias("_identity"), name.alias("_name"), key.alias("_key"), *[c.alias(k) for k, c in block.items()])
    # written before it is filtered: a filter on derived columns would compute them again below
    usable = (F.col("_key") != "") & F.col("_identity").isNotNull()
    for k in b:
        usable = usable & F.col(k).isNotNull()
    base = base.select("_row", F.xxhash64(F.lit(7), "_identity").alias("_identity"), F.when(usable, F.col("_name")).alias("_name"), F.when(usable, F.xxhash64(F.lit(1), "_key", *b)).alias("_form"), F.xxhash64(F.lit(2), *b).alias("_block"))
    base = written(base, base.columns).filter(F.col("_form").isNotNull())
    # the spelling with most words stands for a form; copies that lost their spaces have fewer
    best = F.max_by("_name", F.struct(F.size(F.split("_name", r"[^\p{L}\p{N}]+")), F.col("_name")))
    made = [best.alias("_name"), F.min("_identity").alias("_lo"), F.max("_identity").alias("_hi")]
    hot = hot_keys(base.select("_block"), ["_block"], hot_rows)  # at most hot.MAX_HOT_KEYS rows
    cold = base.join(F.broadcast(hot), "_block", "left_anti").repartition("_block").groupBy("_block", "_form").agg(*made)
    cold = cold.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("_block")))
    heavy = base.join(F.broadcast(hot), "_block", "left_semi").groupBy("_block", "_form").agg(*made).withColumn("_n", F.lit(None).cast("bigint"))
    packed = written(packs(cold.unionByName(heavy), tile), ["_block", *(f"_fs.list.element.{c}" for c in (*SIDE, "_bits"))])
    own = packed.select(F.explode("_fs").alias("f")).filter(F.col("f._lo") < F.col("f._hi")).select(*[F.col(f"f.{c}").alias(f"{s}{c}") for s in "ab" for c in SIDE])  # several ids under one name
    links = accepted(near_pairs(packed, tile).unionByName(own, allowMissingColumns=True), same_name)
    return base.join(components(links), F.col("_form") == F.col("node")).select(F.col("_row").alias(row_id), "entity", F.col("_identity").alias("identity"))


def membership(members: DataFrame, row_id: str) -> DataFrame:
    """(row_id, first): each linked row with the smallest row of its entity, which represents it."""
    firsts = members.groupBy("entity").agg(F.min(row_id).alias("first"))
    return members.join(firsts, "entity").select(row_id, "first")


def linked_pairs(members: DataFrame, row_id: str, tile: int = 1000) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs of rows of one entity with different identities, for those who need them all.

    The output is the square of an entity's rows; its rows meet in tiles of about `tile` by `tile` rows, so that no task has a large entity alone.
    """
    size = members.groupBy("entity").agg(F.ceil(F.count(F.lit(1)) / tile).alias("_m"))
    rows = members.select("entity", F.col(row_id).alias("_id"), F.col("identity").alias("_i")).join(size, "entity").withColumn("_at", F.pmod(F.xxhash64("_id"), F.col("_m")))
    all_of = F.sequence(F.lit(0).cast("bigint"), F.col("_m") - 1)
    a = rows.select("entity", F.col("_id").alias("id_a"), F.col("_i").alias("_ia"), F.col("_at").alias("_r"), F.explode(all_of).alias("_c"))
    b = rows.select("entity", F.col("_id").alias("id_b"), F.col("_i").alias("_ib"), F.col("_at").alias("_c"), F.explode(all_of).alias("_r"))
    return a.join(b, ["entity", "_r", "_c"]).filter((F.col("id_a") < F.col("id_b")) & (F.col("_ia") != F.col("_ib"))).select("id_a", "id_b")


def model_pairs(spellings: DataFrame, row_id: str, name: str) -> DataFrame:
    """(id_a, id_b): all pairs of spellings of one model. Spellings that differ in case, spaces and punctuation only are one form; the numbers of a name are its block."""

    @F.pandas_udf("string")
    def numbers(s: pd.Series) -> pd.Series:
        return s.map(model_numbers)

    base = spellings.select(F.col(row_id).alias("_row"), F.col(name).alias("_name"), letters_and_digits(F.col(name)).alias("_key")).filter(F.col("_key") != "")
    forms = base.groupBy("_key").agg(F.max_by("_name", F.struct(F.size(F.split("_name", r"[^\p{L}\p{N}]+")), F.col("_name"))).alias("_name"))
    own = F.xxhash64("_key")
    forms = forms.select(own.alias("_form"), "_name", own.alias("_lo"), own.alias("_hi"), F.xxhash64(numbers("_name")).alias("_block"), F.lit(None).cast("bigint").alias("_n"))
    found = components(accepted(near_pairs(written(packs(forms))), same_model))
    rows = base.select("_row", F.xxhash64("_key").alias("_form")).join(found, F.col("_form") == F.col("node"), "left")
    members = rows.select(F.col("_row").alias(row_id), F.coalesce("entity", "_form").alias("entity"), F.col("_row").alias("identity"))
    return linked_pairs(members, row_id)
