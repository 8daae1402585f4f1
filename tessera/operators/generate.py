"""The hook for text generators: a caller's function over a table of prompts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Generate = Callable[[list[str]], list[str]]


def each_or_none(run: Callable[[list], list], items: list) -> tuple[list, list[str | None]]:
    """What ``run`` gives for ``items``, and errors: where a batch fails, or gives another number of results, its items are
    tried one by one, and those that fail again are none."""
    try:
        out = list(run(items))
        if len(out) == len(items):
            return out, [None] * len(items)
        error = f"{len(out)} results for {len(items)} items"
    except Exception as e:  # noqa: BLE001 - the caller's function may fail in any way
        error = f"{type(e).__name__}: {e}"
    if len(items) == 1:
        return [None], [error]
    parts = [each_or_none(run, [x]) for x in items]
    return [x for out, _ in parts for x in out], [e for _, errors in parts for e in errors]


def generated(prompts: DataFrame, load: Callable[[], Generate], batch: int = 16, column: str = "prompt") -> DataFrame:
    """``prompts`` with ``raw``, the generated text, and ``error``.

    ``load`` is called once in a task, in the worker, and gives the function that turns a list of prompts into a list of
    texts, so that a model is loaded where it runs. A prompt that fails, alone too, has no text, and its error is told; the
    others of its batch keep theirs. A null prompt is not asked. If ``load`` fails, the task does.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generate = None
        for f in frames:
            raw, error = [None] * len(f), [None] * len(f)
            asked = [k for k, p in enumerate(f[column]) if p is not None]
            if asked and generate is None:
                generate = load()
            for at in range(0, len(asked), batch):
                some = asked[at : at + batch]
                out, errors = each_or_none(generate, [f[column].iloc[k] for k in some])
                for k, text, e in zip(some, out, errors, strict=True):
                    raw[k], error[k] = text, e
            yield f.assign(raw=pd.Series(raw, dtype=object, index=f.index), error=pd.Series(error, dtype=object, index=f.index))

    schema = ", ".join(f"`{c}` {t}" for c, t in prompts.dtypes)
    return prompts.mapInPandas(run, f"{schema}, raw string, error string")
