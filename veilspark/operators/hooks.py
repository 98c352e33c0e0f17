"""Model hook: a user function over batches of texts adds findings to a layer."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import functions as F

from veilspark.schema import FINDING_FIELDS, FINDINGS

RESULT_TYPE = f"struct<findings:{FINDINGS},error:string>"


def model_findings(model: Callable[[list[str]], list[list[dict]]], layer: str, batch: int = 256):
    """Wrap `model(texts) -> one list of finding dicts per text` as an Arrow UDF.

    A dict needs `start`, `end`, `entity_type` and `score`. NULL texts are not
    sent. When a batch fails, its texts are tried one by one, so that only the
    texts the model cannot take carry an error; the message is the error type
    and never holds text.
    """

    def stamped(text: str, found: list[dict]) -> list[dict]:
        rows = []
        for f in found:
            row = dict.fromkeys(FINDING_FIELDS)
            row.update({k: f[k] for k in FINDING_FIELDS if k in f})
            row.update(source=layer, text=text[f["start"] : f["end"]], score=round(float(f["score"]), 2))
            rows.append(row)
        return rows

    def run(texts: list[str]) -> list[tuple[list[dict], str | None]]:
        try:
            return [(stamped(t, f), None) for t, f in zip(texts, model(texts), strict=True)]
        except Exception as error:  # isolation: a failing layer must not fail the scan
            if len(texts) == 1:
                return [([], type(error).__name__)]
            return [run([t])[0] for t in texts]

    @F.pandas_udf(RESULT_TYPE)
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in batches:
            out: list[tuple[list[dict], str | None]] = [([], None)] * len(series)
            at = [i for i, t in enumerate(series) if t is not None]
            for lo in range(0, len(at), batch):
                part = at[lo : lo + batch]
                for i, result in zip(part, run([series.iloc[i] for i in part]), strict=True):
                    out[i] = result
            yield pd.DataFrame({"findings": [o[0] for o in out], "error": [o[1] for o in out]})

    return call
