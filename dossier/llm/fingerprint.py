"""Document fingerprints: one-permutation MinHash, with DataFrame functions only.

Each word is hashed once, each shingle of `SHINGLE` words once, over the words' hashes.  The hash's
leading bits name one of `BINS` bins; a bin keeps its smallest hash.  Empty bins are filled by optimal
densification: bin i asks the others in a random order of its own (i ^ mask, the masks in a fixed random
order) and takes the value of the first that was filled.  The fingerprint packs the lowest `BITS` bits
of each bin's value as hex.  Two bins agree by chance with probability 2**-BITS; the likeness corrects
for that.

A document's bins are made inside its row: its shingles' hashes are sorted together with one sentinel
(the largest value) for each bin, and the first of each bin stays.  So nothing is exploded or grouped.
The edited text shares the original's head: the head's bins are made once and merged with those of the
two tails.

Documents are dealt once, by an order-preserving bucket of their id, and the next document in id order
is found in the bucket (the first row of the following bucket is added to each).

Defined cases: a text of fewer than SHINGLE words is one shingle, one without words (or null) the empty
shingle, so equal texts have equal fingerprints and empty ones are alike; null ids come first; rows of
the same id follow each other by text; an empty table gives no rows, and a table of one row follows
itself; a very long text is one row's array of 8 bytes a word; ids are whole numbers (others raise
TypeError); a column of the caller's with the output's name is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.llm._order import bounds, bucket_of, buckets_for
from dossier.llm._pack import pack, unpack, whole_number

BINS, BITS, SHINGLE = 128, 8, 5
_SHIFT = 64 - (BINS - 1).bit_length()
_TOP = (1 << _SHIFT) - 1
_SPACES = r"[\x20\x09-\x0D]+"
#: Bins that an empty one asks one by one before it looks for the first of all filled ones.
_ASKED = 16


def _order() -> list[int]:
    """The masks 1 .. BINS - 1 in a fixed random order (a multiplicative hash)."""
    return sorted(range(1, BINS), key=lambda m: m * 0x9E3779B97F4A7C15 % (1 << 64) ^ m * 0xD6E8FEB86659FD93 % (1 << 64))


def _longs(values: list[int]) -> Column:
    return F.array(*[F.lit(v).cast("long") for v in values])


#: One sentinel for each bin, in bin order; no shingle is above it.
def _sentinels() -> Column:
    return _longs([(b - BINS // 2 << _SHIFT) | _TOP for b in range(BINS)])


def word_hashes(parts: Column, upto: int = 0) -> Column:
    """Hashes of the words of a split text but the last `upto`, without an empty one at either end."""
    before = F.when(parts[0] == "", 1).otherwise(0)
    after = F.lit(upto) if upto else F.when(F.element_at(parts, -1) == "", 1).otherwise(0)
    return F.transform(F.slice(parts, before + 1, F.greatest(F.size(parts) - before - after, F.lit(0))), lambda w: F.xxhash64(w))


def shingle_hashes(hashes: Column, short: Column) -> Column:
    """Hashes of the shingles of an array of word hashes: one of all words where they are too few and `short` holds."""
    n = F.size(hashes)
    starts = F.when(n >= SHINGLE, F.sequence(F.lit(0), n - SHINGLE)).when(short, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.get(hashes, i), *[F.get(hashes, i + k) for k in range(1, SHINGLE)]))


def _step(rows: DataFrame, **columns: Column) -> DataFrame:
    """Columns that the next step's lambdas read, as a projection of their own."""
    return rows.withColumns(columns)


def _firsts(ordered: str) -> Column:
    """The least hash of each bin, of a sorted array that has all bins."""
    o = F.col(ordered)
    return F.concat(F.slice(o, 1, 1), F.filter(o, lambda x, i: F.shiftright(x.bitwiseXOR(F.get(o, i - 1)), _SHIFT) != 0))


def _low(bins: str) -> Column:
    """The bits that are packed, of the filled bins (an empty one: null)."""
    return F.transform(F.col(bins), lambda x: F.when(x.bitwiseAND(F.lit(_TOP)) != _TOP, x.bitwiseAND(F.lit((1 << BITS) - 1)).cast("short")))


def _filled(low: str) -> Column:
    return F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.get(F.col(low), i).isNotNull())


def _densified(low: str, filled: str) -> Column:
    """The packed bits of all bins: an empty one's are those of the first filled one in its order."""
    masks, rank = _order(), [0] * BINS
    for k, m in enumerate(masks):
        rank[m] = k
    in_order, rank = F.array(*map(F.lit, masks)), F.array(*map(F.lit, rank))

    def value(x: Column, i: Column) -> Column:
        best = F.array_min(F.transform(F.col(filled), lambda b: F.get(rank, i.bitwiseXOR(b))))
        asked = [F.get(F.col(low), i.bitwiseXOR(F.lit(m))) for m in masks[:_ASKED]]
        return F.coalesce(x, *asked, F.get(F.col(low), i.bitwiseXOR(F.get(in_order, best))))

    return F.when(F.size(filled) == BINS, F.col(low)).otherwise(F.transform(F.col(low), value))


def hexed(bits: Column) -> Column:
    """The fingerprint of the packed bits of all bins."""
    digits = F.array(*[F.lit(f"{v:0{BITS // 4}x}") for v in range(1 << BITS)])
    return F.array_join(F.transform(bits, lambda x: F.get(digits, x)), "")


def bits_of(rows: DataFrame, **hashes: str) -> DataFrame:
    """rows with columns of shingle hashes (with all sentinels) turned into packed bits (new name = old name)."""
    rows = _step(rows, **{f"_o_{new}": F.sort_array(F.col(old)) for new, old in hashes.items()})
    rows = _step(rows, **{f"_b_{new}": _firsts(f"_o_{new}") for new in hashes})
    rows = _step(rows, **{f"_l_{new}": _low(f"_b_{new}") for new in hashes})
    rows = _step(rows, **{f"_f_{new}": _filled(f"_l_{new}") for new in hashes})
    rows = _step(rows, **{new: _densified(f"_l_{new}", f"_f_{new}") for new in hashes})
    return rows.drop(*[f"_{k}_{new}" for k in "oblf" for new in hashes], *hashes.values())


def fingerprints(docs: DataFrame, text: str = "text", fingerprint: str = "fingerprint") -> DataFrame:
    """docs plus their fingerprint."""
    clean = docs.drop(fingerprint)
    rows = _step(pack(clean, _text=text), _p=F.split(F.coalesce(F.col("_text"), F.lit("")), _SPACES))
    rows = _step(rows, _w=word_hashes(F.col("_p")))
    rows = _step(rows, _s=F.concat(shingle_hashes(F.col("_w"), F.lit(True)), _sentinels()))
    rows = bits_of(rows, _bits="_s")
    return unpack(rows, clean, {}, {fingerprint: hexed(F.col("_bits"))}, _text=text)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity, 0 to 1, of the packed bits of two texts."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))
    chance = 2.0**-BITS
    return F.greatest(F.lit(0.0), (same / F.lit(BINS) - F.lit(chance)) / F.lit(1 - chance))


def dealt_in_order(docs: DataFrame, key: str, text: str) -> DataFrame:
    """_bucket, _order (the id; null as the least long), _text, _extra (not a row of docs: the first of the next bucket)."""
    whole_number(docs, key)
    rows = docs.select(F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_text"), F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(-(1 << 63))).alias("_order"))
    cuts = bounds(rows, "_order", buckets_for(docs))
    dealt = rows.withColumn("_bucket", bucket_of(F.col("_order"), cuts)).withColumn("_extra", F.lit(False))
    # One line a bucket: the least id of each, which goes to the bucket before as well.
    first = {r["_bucket"]: r["o"] for r in dealt.groupBy("_bucket").agg(F.min("_order").alias("o")).collect()}
    order = sorted(first)
    if order:
        before = {first[b]: order[k - 1] for k, b in enumerate(order)}  # the first follows the last
        lead = rows.where(F.col("_order").isin(list(before)))
        if len(before) < 64:
            target = F.create_map(*[F.lit(x) for o, b in before.items() for x in (o, b)])
            lead = lead.withColumn("_bucket", target[F.col("_order")].cast("int"))
        else:
            small = docs.sparkSession.createDataFrame(sorted(before.items()), "_order long, _bucket int")
            lead = lead.join(F.broadcast(small), "_order").select(*rows.columns, "_bucket")  # at most MOST_BUCKETS lines
        dealt = dealt.unionByName(lead.withColumn("_extra", F.lit(True)))
    return dealt


def compare_edited(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: key, n_chars, edited_sha256, both fingerprints, and the likeness of its own to the edited
    text's (the last quarter of its code points replaced by the first as many of the next document) and to
    the next document's."""
    run = Window.partitionBy("_bucket").orderBy("_extra", "_order", "_text")
    rows = dealt_in_order(docs, key, text).withColumn("_next", F.lead("_text").over(run))
    t = F.col("_text")
    rows = _step(rows, _n=F.char_length(t)).withColumn("_q", F.floor(F.col("_n") / 4).cast("int"))
    rows = _step(rows, _head=F.substring(t, F.lit(1), F.col("_n") - F.col("_q")))
    rows = _step(rows, _p=F.split("_head", _SPACES), _edited=F.concat("_head", F.substring(F.coalesce(F.col("_next"), F.lit("")), F.lit(1), F.col("_q"))))
    # The words that end in the head are common to both texts; the rest begins with the word that the head breaks off in.
    rows = _step(rows, _common=F.char_length("_head") - F.char_length(F.element_at("_p", -1)), _sha=F.sha2("_edited", 256))
    rest = lambda x: F.split(F.substring(F.col(x), F.col("_common") + 1, F.lit((1 << 31) - 1)), _SPACES)
    rows = _step(rows, _p0=rest("_text"), _p1=rest("_edited"), _w=word_hashes(F.col("_p"), 1))
    last = F.slice("_w", F.greatest(F.size("_w") - (SHINGLE - 2), F.lit(1)), SHINGLE - 1)
    rows = _step(rows, _t0=F.concat(last, word_hashes(F.col("_p0"))), _t1=F.concat(last, word_hashes(F.col("_p1"))), _s=F.concat(shingle_hashes(F.col("_w"), F.lit(False)), _sentinels()))
    rows = _step(rows, _o=F.sort_array("_s"))
    rows = _step(rows, _b=_firsts("_o"))
    short = F.size("_w") < SHINGLE  # then all words are in the tail, and may be too few for a shingle
    rows = _step(rows, _h0=F.concat("_b", shingle_hashes(F.col("_t0"), short)), _h1=F.concat("_b", shingle_hashes(F.col("_t1"), short)))
    rows = bits_of(rows.select("_bucket", "_order", "_text", "_extra", "_n", "_sha", "_h0", "_h1"), _bits="_h0", _edited_bits="_h1")
    rows = rows.withColumn("_next_bits", F.lead("_bits").over(run)).where(~F.col("_extra"))
    real = F.when(F.col("_order") != -(1 << 63), F.col("_order"))
    bits, other = F.col("_bits"), F.col("_edited_bits")
    return rows.select(real.alias(key), F.col("_n").cast("long").alias("n_chars"), F.col("_sha").alias("edited_sha256"), hexed(bits).alias("fingerprint"), hexed(other).alias("edited_fingerprint"), likeness(bits, other).alias("near_edited"), likeness(bits, F.col("_next_bits")).alias("near_next"))
