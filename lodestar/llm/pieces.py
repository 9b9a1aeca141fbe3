"""SentencePiece encoding and decoding by a table of distinct chunks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.llm.chunktable import ChunkTable, _path, as_ids
from lodestar.llm.columns import map_column, quoted

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Texts with a run of spaces, a space at an end, or the mark itself: there a chunk isn't "mark, then word".
IRREGULAR = r"(?:^ )|(?: $)|  |\x{2581}"
_OPENED: dict[str, tuple] = {}


def pieces_stay_in_words(processor) -> bool:
    """Whether no piece of the model has a mark after another character, so that no piece crosses the start of a word."""
    names = (processor.id_to_piece(i) for i in range(processor.get_piece_size()))
    return not any(MARK in p.lstrip(MARK) for p in names)


def open_model(name: str):
    """(processor, chunk table) of a model, one a worker."""
    if name not in _OPENED:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=_path(name))
        if not pieces_stay_in_words(sp):
            raise ValueError("the model has pieces that cross word marks; texts must be encoded whole")
        _OPENED[name] = sp, ChunkTable(lambda words: as_ids(sp.encode(words, num_threads=1)), IRREGULAR)
    return _OPENED[name]


def encode_pieces(docs: DataFrame, text: str = "text", model: str = MODEL, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """docs with the ids of every whole text (array<int>, as the library's encode) and the text decoded from these ids.

    Every word is led by a mark, the first by the one that the library puts before a text, so each distinct marked word of
    a slice of rows is segmented once and ids are joined back by position. A text with runs of spaces or the mark itself is
    given to the library whole. A null or empty text has no ids and decodes to an empty text. All other columns stay;
    an existing column named as an output is replaced. A table without rows gives none.
    """

    def run(texts: pa.Array) -> list[pa.Array]:
        sp, table = open_model(model)
        values, lengths = table.encode(texts)
        ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        flat = values.astype(np.int32)
        back = sp.decode([flat[x:y].tolist() for x, y in zip(ends[:-1], ends[1:], strict=True)], num_threads=1) if len(lengths) else []
        return [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(back, pa.string())]

    return map_column(docs, quoted(text), [T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())], run)


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: ids and decoded text as digests."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = encode_pieces(docs)
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
