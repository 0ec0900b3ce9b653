"""Language ID by Bayesian fusion of evidence.

A document's posterior over languages is proportional to the product of

  text      likelihood of its hashed byte trigrams without digits (numbers, addresses and
            keys are of no language), tempered for their dependence
  declared  probability of the declared markup language given the language
  host      prior of its host, smoothed towards that of the address suffix, which
            is smoothed towards that of the whole table

One more hypothesis is that the text is of no modelled language. Its likelihood
of a trigram lies UNKNOWN_AT of the way from what the nearest language expects of its
own texts to that of bins all alike; it is told by length, has a prior of UNKNOWN,
and says nothing of hosts and declared languages. Such texts are undetermined.

The languages are all declared codes, of two or three letters with or without
further subtags ("pt-BR" is pt); other declared values are none. The trigram model
is counted over all documents with a declared language. Texts are held against
BLOCK_LANGUAGES languages in a pass, however many there are. A text carries on
the languages whose likelihood is within CARRIED of its best: priors and
declared languages move a language by less than 100 in a table of 10^10 rows, so
that what others would add is far below a double's precision.

The tables of declared languages, suffixes and hosts are grouped counts of the
language that the text alone suggests, over all documents; each is combined
before its shuffle, so a host with a third of all rows is one row per task and
language.

Cases: null or empty text leaves the other evidence; a null or unknown declared
language, host or suffix leaves the rest; repeated rows count each; languages
that are equally likely are taken in the order of their codes; a table
with no declared language at all has no model, and every row is undetermined; an
empty table gives an empty result; very long texts are read in blocks of bytes.
Further columns are carried, whatever their names; those named lang, posterior,
text_lang or kept are replaced. A document is kept if its text has a letter and the
posterior of its language is MIN_POSTERIOR or more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import join_checked, staged, steps

BINS = 1 << 15
#: Languages that a pass over the texts holds models of: 16 MiB.
BLOCK_LANGUAGES = 128
TEMPER = 0.25
#: Pseudo-counts of the parent's shares.
HOST_WEIGHT, SUFFIX_WEIGHT, DECLARED_WEIGHT = 20.0, 50.0, 5.0
MIN_POSTERIOR = 0.6
UNKNOWN, UNKNOWN_AT = 0.01, 2 / 3
CARRIED = 300.0
#: Most bytes whose likelihoods are held at a time, and languages that a task counts at a time.
_BLOCK, _COUNTED = 1 << 20, 64
_OUT = ("lang", "posterior", "text_lang", "kept")


def code(declared: Column) -> Column:
    """The language code of a declared value, null where it begins with none: 26^2 + 26^3 codes at most."""
    found = F.lower(F.regexp_extract(declared, r"^\s*([A-Za-z]{2,3})(?:[-_][A-Za-z0-9_-]*)?\s*$", 1))
    return F.when(found != "", found)


def trigrams(texts: pa.StringArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bins, owners) of the byte trigrams without a digit inside lower-cased texts, each with a blank before and after; a text that is alone and long comes in blocks."""
    lists = pc.binary_join_element_wise("", pc.utf8_lower(pc.fill_null(texts, "")), "", " ")
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    raw = np.frombuffer(lists.cast(pa.binary()).buffers()[2] or b"", np.uint8)
    offsets = np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1].astype(np.int64)
    raw = raw[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    if len(texts) == 1:
        for a in range(0, max(len(raw) - 2, 1), _BLOCK):
            part = raw[a : a + _BLOCK + 2]
            at = np.arange(max(len(part) - 2, 0))
            bins = _bins(part, at[_has_no_digit(part, at)])
            yield bins, np.zeros(len(bins), np.int64)
        return
    sizes = np.maximum(np.diff(offsets) - 2, 0)
    ends = np.cumsum(sizes)
    at = np.repeat(offsets[:-1] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)
    wordy = _has_no_digit(raw, at)
    yield _bins(raw, at[wordy]), np.repeat(np.arange(len(sizes)), sizes)[wordy]


def _has_no_digit(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    digit = (raw >= 48) & (raw <= 57)
    return ~(digit[at] | digit[at + 1] | digit[at + 2])


def _bins(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    b = raw.astype(np.uint32)
    mixed = (b[at] * np.uint32(0x9E3779B1)) ^ (b[at + 1] * np.uint32(0x85EBCA77)) ^ (b[at + 2] * np.uint32(0xC2B2AE3D))
    return ((mixed * np.uint32(0x27D4EB2F)) >> np.uint32(32 - 15)).astype(np.int64)


def _counted(held: dict[str, np.ndarray]) -> pa.RecordBatch:
    found = [(k, np.flatnonzero(v)) for k, v in held.items()]
    names = pa.DictionaryArray.from_arrays(np.repeat(np.arange(len(found), dtype=np.int32), [len(b) for _, b in found]), pa.array([k for k, _ in found], pa.string())).cast(pa.string())
    bins = np.concatenate([b for _, b in found])
    return pa.RecordBatch.from_arrays([names, pa.array(bins, pa.int32()), pa.array(np.concatenate([held[k][b] for k, b in found]))], names=["lang", "bin", "n"])


def _count(batches):
    """Counts of the bins by language, for a few languages at a time."""
    held: dict[str, np.ndarray] = {}
    for batch in batches:
        for step in steps(batch, "text", _BLOCK):
            d = step.column("declared").dictionary_encode()
            which, names = d.indices.to_numpy(zero_copy_only=False), d.dictionary.to_pylist()
            for bins, owners in trigrams(step.column("text")):
                lang = which[owners]
                for k in np.unique(which).tolist():
                    if names[k] not in held and len(held) == _COUNTED:
                        yield _counted(held)
                        held = {}
                    counts = np.bincount(bins[lang == k] if len(names) > 1 else bins, minlength=BINS)
                    held[names[k]] = held[names[k]] + counts if names[k] in held else counts
    if held:
        yield _counted(held)


def count_trigrams(rows: DataFrame) -> DataFrame:
    """The written counts (lang, bin, n) of rows (text, declared) that declare a language."""
    counted = rows.select("text", "declared").filter("declared is not null").mapInArrow(_count, "lang string, bin int, n long")
    return staged(counted.groupBy("lang", "bin").agg(F.sum("n").alias("n")), "trigrams")


def text_model(counts: DataFrame, languages: list[str]) -> np.ndarray:
    """Log probabilities by language and bin. BLOCK_LANGUAGES x BINS counts at most reach the driver."""
    found = counts.filter(F.col("lang").isin(languages)).toArrow()
    table = np.full((len(languages), BINS), 0.5)
    if found.num_rows:
        lang = pc.index_in(found.column("lang"), pa.array(languages)).to_numpy()
        table[lang, found.column("bin").to_numpy()] += found.column("n").to_numpy()
    return np.log(table / table.sum(1, keepdims=True)).astype(np.float32)


_EVIDENCE = [
    T.StructField("top", T.DoubleType()),
    T.StructField("likely", T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("ll", T.DoubleType())]))),
    T.StructField("other", T.DoubleType()),
    T.StructField("letters", T.BooleanType()),
]


def text_evidence(rows: DataFrame, languages: list[str], model: np.ndarray) -> DataFrame:
    """rows without text, with likely (the languages within CARRIED of the best, with tempered log likelihoods), top (the best's), other (that of no language) and letters."""
    kept = [f for f in rows.schema.fields if f.name != "text"]
    schema = T.StructType([*kept, *_EVIDENCE])
    table = np.ascontiguousarray(model.T)
    own = (np.exp(model.astype(np.float64)) * model).sum(1)
    unknown = own + UNKNOWN_AT * (-np.log(BINS) - own)
    names = pa.array(languages, pa.string())

    def run(batches):
        for batch in batches:
            for step in steps(batch, "text", _BLOCK):
                texts = step.column("text")
                ll, size = np.zeros((len(texts), len(languages))), np.zeros(len(texts))
                for bins, owners in trigrams(texts):
                    ll += np.stack([np.bincount(owners, table[bins, k], len(texts)) for k in range(table.shape[1])], 1)
                    size += np.bincount(owners, minlength=len(texts))
                ll *= TEMPER
                top = ll.max(1)
                near = ll >= top[:, None] - CARRIED
                which = pa.DictionaryArray.from_arrays(np.nonzero(near)[1].astype(np.int32), names).cast(pa.string())
                pairs = pa.StructArray.from_arrays([which, pa.array(ll[near])], names=["lang", "ll"])
                likely = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(near.sum(1))], pa.int32()), pairs)
                letters = pc.match_substring_regex(pc.fill_null(texts, ""), r"\p{L}")
                yield pa.RecordBatch.from_arrays([*[step.column(f.name) for f in kept], pa.array(top), likely, pa.array(TEMPER * size * unknown[ll.argmax(1)]), letters], names=[f.name for f in schema])

    return rows.mapInArrow(run, schema)


def evidence(rows: DataFrame, counts: DataFrame, languages: list[str], block: int = BLOCK_LANGUAGES) -> DataFrame:
    """text_evidence over all languages, a block of them in a pass."""
    blocks = [languages[a : a + block] for a in range(0, len(languages), block)]
    if len(blocks) == 1:
        return staged(text_evidence(rows, blocks[0], text_model(counts, blocks[0])), "languages")
    numbered = staged(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    # A row of each pass and text: as many as there are blocks.
    passes = [staged(text_evidence(numbered.select("row", "text"), b, text_model(counts, b)), "languages") for b in blocks]
    union = passes[0]
    for p in passes[1:]:
        union = union.unionByName(p)
    best = union.groupBy("row").agg(F.max("top").alias("top"), F.flatten(F.collect_list("likely")).alias("likely"), F.max_by("other", "top").alias("other"), F.first("letters").alias("letters"))
    best = best.withColumn("likely", F.array_sort(F.filter("likely", lambda x: x["ll"] >= F.col("top") - CARRIED)))
    return staged(numbered.drop("text").join(best, "row").drop("row"), "languages")


def shares(found: DataFrame, by: str) -> DataFrame:
    """(by, of, all): how often the texts of each value suggest each language, as a map, and how many there are."""
    counted = found.filter(F.col(by).isNotNull() & F.col("first").isNotNull()).groupBy(by, "first").agg(F.count("*").alias("n"))
    pairs = F.map_from_entries(F.collect_list(F.struct("first", "n")))  # a pair per language
    return staged(counted.groupBy(by).agg(pairs.alias("of"), F.sum("n").alias("all")), by)


def identify(rows: DataFrame, block: int = BLOCK_LANGUAGES) -> DataFrame:
    """rows (text, declared, host, suffix and others) without text, with lang, posterior, text_lang and kept."""
    inputs = ("text", "declared", "host", "suffix")
    others = [F.col(f"`{c}`") for c in rows.columns if c not in (*inputs, *_OUT)]
    columns = [c for c in rows.columns if c != "text" and c not in _OUT]
    rows = rows.select(F.col("text").cast("string"), F.struct("declared", "host", "suffix", *others).alias("rest"), code(F.col("declared").cast("string")).alias("declared"), F.col("host").cast("string"), F.col("suffix").cast("string"))
    counts = count_trigrams(rows)
    languages = sorted(r.lang for r in counts.select("lang").distinct().collect())  # codes, so at most 18,252
    rest = [F.col(f"rest.`{c}`") for c in columns]
    if not languages:
        none = F.lit(None).cast("string")
        return rows.select(*rest, none.alias("lang"), F.lit(0.0).alias("posterior"), none.alias("text_lang"), F.lit(False).alias("kept"))
    k = len(languages)
    found = evidence(rows, counts, languages, block)
    first = F.filter("likely", lambda x: x["ll"] == F.col("top"))[0]["lang"]
    found = found.withColumn("first", F.when(F.col("other") <= F.col("top"), first))
    everything = found.filter(F.col("first").isNotNull()).groupBy("first").agg(F.count("*").alias("n"))
    overall = everything.agg(F.map_from_entries(F.collect_list(F.struct("first", "n"))).alias("seen"), F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    table = lambda by, prefix: shares(found, by).select(F.col(by), F.col("of").alias(f"{prefix}_of"), F.col("all").alias(f"{prefix}_all"))
    out = found.crossJoin(F.broadcast(overall))  # one row
    for by in ("declared", "suffix", "host"):
        out = join_checked(out, table(by, by), by, "left", 200 + 16 * k)
    of = lambda m, lang: F.coalesce(F.try_element_at(m, lang), F.lit(0)).cast("double")

    def log_posterior(x: Column) -> Column:
        lang = x["lang"]
        overall = (of(F.col("seen"), lang) + 1.0 / k) / (F.col("total") + 1.0)
        suffix = (of(F.col("suffix_of"), lang) + SUFFIX_WEIGHT * overall) / (F.coalesce("suffix_all", F.lit(0)) + SUFFIX_WEIGHT)
        host = (of(F.col("host_of"), lang) + HOST_WEIGHT * suffix) / (F.coalesce("host_all", F.lit(0)) + HOST_WEIGHT)
        said = F.log((of(F.col("declared_of"), lang) + DECLARED_WEIGHT / k) / (of(F.col("seen"), lang) + DECLARED_WEIGHT))
        # A code that no text suggests says nothing.
        return F.struct((x["ll"] - F.col("top") + F.log(host) + F.when(F.col("declared_of").isNull(), 0.0).otherwise(said)).alias("log"), lang.alias("lang"))

    other = F.col("other") - F.col("top") + float(np.log(UNKNOWN)) + F.when(F.col("declared_of").isNull(), 0.0).otherwise(-float(np.log(k)))
    out = out.withColumn("logs", F.concat(F.transform("likely", log_posterior), F.array(F.struct(other.alias("log"), F.lit(None).cast("string").alias("lang")))))
    out = out.withColumn("best", F.array_max(F.transform("logs", lambda x: x["log"])))
    posterior = 1 / F.aggregate("logs", F.lit(0.0), lambda a, x: a + F.exp(x["log"] - F.col("best")))
    lang = F.filter("logs", lambda x: x["log"] == F.col("best"))[0]["lang"]
    out = out.select(*rest, lang.alias("lang"), posterior.alias("posterior"), F.col("first").alias("text_lang"), F.col("letters"))
    return out.withColumn("kept", F.col("letters") & F.col("lang").isNotNull() & (F.col("posterior") >= MIN_POSTERIOR)).drop("letters")


#: An address in a text, by its scheme, its first label or its @, with its last label.
_ADDRESS = r"(?i)(?:\bhttps?://|\bwww\.|@)[a-z0-9](?:[a-z0-9.-]*[a-z0-9])?\.([a-z]{2,24})\b"


def document_rows(docs: DataFrame) -> DataFrame:
    """Documents as evidence: the language column is what is declared, the source is the host, the suffix is that of the first address in the text, a site's or a mailbox."""
    suffix = F.lower(F.regexp_extract("text", _ADDRESS, 1))
    return docs.select("doc_id", "text", F.col("lang").alias("declared"), F.col("source").alias("host"), F.when(suffix != "", suffix).alias("suffix"))


def page_rows(pages: DataFrame) -> DataFrame:
    """Pages as evidence: text without markup, the html element's language, host and last label of the address."""
    text = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    declared = F.lower(F.regexp_extract("html", r"(?i)<html[^>]*\blang\s*=\s*[\"']?([a-z]{2,3})", 1))
    host = F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    blank = lambda c: F.when(c != "", c)
    return pages.select("page_id", text.alias("text"), blank(declared).alias("declared"), blank(host).alias("host"), blank(F.regexp_extract(host, r"\.([^.]+)$", 1)).alias("suffix"))


