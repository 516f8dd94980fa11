"""Main text of web pages by a recurrent block labeller.

Each page becomes the sequence of its leaf blocks; a bidirectional LSTM reads every block's tag path and hashed
words in both directions and labels each with the whole page in view. Blocks labelled as the article are joined.
The weights are trained by ``html_train`` on generated pages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_blocks import Block, blocks
from .html_model import BiLstm, batch_of, features

#: Blocks of pages labelled together; pages of like length share a batch, a longer page has one of its own.
BATCH_BLOCKS = 8192


def label(model: BiLstm, pages: list[list[Block]]) -> list[np.ndarray]:
    """For each page, whether each block belongs to the article."""
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    order = sorted(range(len(pages)), key=lambda k: len(pages[k]))
    group: list[int] = []
    for at, k in enumerate(order):
        group.append(k)
        longest = len(pages[order[at + 1]]) if at + 1 < len(order) else 0
        if not longest or (len(group) + 1) * longest > BATCH_BLOCKS or longest > 1.3 * len(pages[group[0]]) + 4:
            if pages[k]:
                dense, paths = batch_of([features(pages[j]) for j in group])
                logits = model.forward(dense, paths)
                for row, j in enumerate(group):
                    out[j] = logits[row, : len(pages[j])] >= 0
            group = []
    return out


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars (code points of the text).

    A null or empty page, or one without an article, gives an empty text. Null ids and urls are returned as they are;
    repeated rows give equal rows; pages of any length are read whole. Other columns are ignored.
    """
    source = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).cast("string").alias("html"))
    schema = source.drop("html").withColumns({"text": F.lit(""), "n_chars": F.lit(0).cast("long")}).schema
    shared = pages.sparkSession.sparkContext.broadcast(BiLstm.load())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                found = [blocks(h or "") for h in batch.column(2).to_pylist()]
                texts = ["\n".join(b.text for b, m in zip(page, mine, strict=True) if m) for page, mine in zip(found, label(model, found), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return source.mapInArrow(run, schema)
