"""User models as batch callables: loaded once per Python worker, fed Arrow batches."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame

_LOADED: dict[str, object] = {}


def load_once(key: str, loader: Callable[[], object]) -> object:
    """Model of this worker process for ``key``."""
    if key not in _LOADED:
        _LOADED[key] = loader()
    return _LOADED[key]


BOX_SCHEMA = "det_id int, x1 double, y1 double, x2 double, y2 double, score double, class_id int"


def detect(
    pages: DataFrame, loader: Callable[[], Callable[[pd.DataFrame], Sequence[Sequence[tuple]]]], *,
    keys: Sequence[str] = ("page_id",), model: str = "comic",
) -> DataFrame:
    """Run a detector over page rows; only ``keys`` and the found boxes leave the batch.

    ``loader`` returns a callable that takes a batch and gives, per row, tuples
    (x1, y1, x2, y2, score, class_id).
    """
    types = {f.name: f.dataType.simpleString() for f in pages.schema}
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", " + BOX_SCHEMA
    columns = [*keys, "det_id", "x1", "y1", "x2", "y2", "score", "class_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fn = load_once(model, loader)
        for batch in batches:
            heads = batch[list(keys)].itertuples(index=False)
            rows = [(*head, i, *box) for head, boxes in zip(heads, fn(batch)) for i, box in enumerate(boxes)]
            yield pd.DataFrame(rows, columns=columns)

    return pages.mapInPandas(run, schema)


def recognize(
    crops: DataFrame,
    local: Callable[[], Callable[[pd.Series], Sequence[str]]],
    cloud: Callable[[], Callable[[pd.Series], Sequence[str]]] | None = None,
    *,
    keys: Sequence[str] = ("page_id", "det_id"),
    crop: str = "crop",
    engine: str = "auto",
) -> DataFrame:
    """Text of each crop: ``text, engine, ocr_ms``.

    The local engine sees every non-empty crop of a batch, the cloud engine only those left blank;
    both work in one pass, so no crop is decoded or recognised twice.  An empty crop gives ''.
    When the local engine fails on a batch it is asked again crop by crop, and only the crops it fails on go to the cloud
    engine; without one the failure is raised.
    """
    types = {f.name: f.dataType.simpleString() for f in crops.schema}
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", text string, engine string, ocr_ms double"

    def timed(fn, values: pd.Series) -> tuple[list[str], float]:
        start = time.perf_counter()
        texts = [t or "" for t in fn(values)] if len(values) else []
        return texts, (time.perf_counter() - start) * 1000.0 / max(1, len(values))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = load_once(f"{engine}/local", local)
        for batch in batches:
            out = batch[list(keys)].reset_index(drop=True)
            values = batch[crop].reset_index(drop=True)
            out["text"], out["engine"], out["ocr_ms"] = "", "siliconflow" if cloud else "paddle", 0.0
            filled = values.map(lambda v: v is not None and bool(v["data"])).astype(bool)
            where = values.index[filled]
            read: dict[int, str] = {}
            try:
                texts, ms = timed(first, values[where])
                read = dict(zip(where, texts))
                out.loc[where, "ocr_ms"] = ms
            except Exception:
                if cloud is None:
                    raise
                for i in where:
                    try:
                        texts, ms = timed(first, values[[i]])
                    except Exception as error:
                        logging.getLogger(__name__).warning("local engine failed on a crop: %s", error)
                        continue
                    read[i] = texts[0]
                    out.loc[i, "ocr_ms"] = ms
            for i, text in read.items():
                out.loc[i, "text"] = text
            good = where[[bool(read.get(i, "").strip()) for i in where]] if len(where) else where
            out.loc[good, "engine"] = "paddle"
            blank = where.difference(good)
            if cloud is not None and len(blank):
                texts, ms = timed(load_once(f"{engine}/cloud", cloud), values[blank])
                out.loc[blank, "text"], out.loc[blank, "ocr_ms"] = texts, ms
            yield out

    return crops.mapInPandas(run, schema)
