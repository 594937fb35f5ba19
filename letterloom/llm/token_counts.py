"""Operator 5: token counts of whole texts, with a shortcut for pre-tokens that are one token for certain."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from letterloom.llm.common import text_batches
from letterloom.llm.tokens import PartEncoder, PartLibrary, keeps_space, load

#: The public pre-token pattern of byte-level vocabularies (a fixed value of that file format).
PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Characters on whose classes every Unicode version agrees; a part with others is left whole to the library.
SETTLED = regex.compile(r"[\t\n\r -~¡-ȳΑ-ΡΣ-ωА-я‐-‟…]*")


def whole_tokens(vocabulary: str) -> frozenset[str]:
    """Vocabulary strings proved to be one pre-token that the library encodes as one token.

    Every entry is turned back into text and encoded alone; it counts only if the library returns exactly its
    own id and the pattern leaves it whole. The set is bounded by the vocabulary.
    """
    tok = load(vocabulary)
    ids = list(range(tok.get_vocab_size(with_added_tokens=False)))
    texts = tok.decode_batch([[i] for i in ids], skip_special_tokens=False)
    added = {t.content for t in tok.get_added_tokens_decoder().values()}
    found = set()
    for i, text, e in zip(ids, texts, tok.encode_batch(texts, add_special_tokens=False), strict=True):
        if text not in added and e.ids == [i] and SETTLED.fullmatch(text) and PRETOKEN.findall(text) == [text]:
            found.add(text)
    return frozenset(found)


_ENCODERS: dict[str, PartEncoder] = {}


def count_encoder(vocabulary: str, proved: frozenset[str]) -> PartEncoder:
    """Token counts of parts of texts: proved pre-tokens count one, only the rest is merged by the library.

    A worker keeps the last one, and what it remembers, from task to task.
    """
    if vocabulary not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[vocabulary] = _count_encoder(vocabulary, proved)
    return _ENCODERS[vocabulary]


def _count_encoder(vocabulary: str, proved: frozenset[str]) -> PartEncoder:
    tok = load(vocabulary)
    if not keeps_space(tok):
        raise ValueError("the shortcut is proved for byte-level vocabularies only")
    added = [t.content for t in tok.get_added_tokens_decoder().values()]
    library = PartLibrary(tok)
    merged: dict[str, int] = {}

    def merge(strings: list[str]) -> None:
        if len(merged) > 500_000:
            merged.clear()
        new = list({s for s in strings if s not in merged})
        merged.update(zip(new, (len(ids) // 4 for ids in library(new)), strict=True))

    def count(strings: list[str]) -> list[int]:
        rest: list[list[str]] = []
        ones: list[int] = []
        for s in strings:
            if SETTLED.fullmatch(s) and not any(a in s for a in added):
                found = PRETOKEN.findall(s)
                left = [p for p in found if p not in proved]
                ones.append(len(found) - len(left))
                rest.append(left)
            else:  # special strings and unsettled characters: the library takes the part whole
                ones.append(0)
                rest.append([s])
        merge([p for left in rest for p in left])
        return [n + sum(map(merged.__getitem__, left)) for n, left in zip(ones, rest, strict=True)]

    return PartEncoder(count, " ")


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of ``docs`` (doc_id, text).

    A null or empty text has no bytes and no tokens; repeated rows are counted each; other columns are not read.
    """
    proved = docs.sparkSession.sparkContext.broadcast(whole_tokens(vocabulary))
    docs = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = count_encoder(vocabulary, proved.value)
        for batch in batches:
            counts = [sum(v) for _, texts in text_batches(batch.column("text"), 2_000_000) for v in encode(texts)]
            sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column("text")), 0).cast(pa.int64())
            yield pa.record_batch([batch.column("doc_id"), sizes, pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    import pyarrow.compute  # noqa: F401

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long"
    return docs.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)
