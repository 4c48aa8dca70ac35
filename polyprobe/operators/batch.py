"""Distributed model calls.

``load`` is called once per Python worker and returns the model as a function
on a list of prompts; Arrow carries the batches.  A score column is expensive:
write it to a table before using it more than once.  ``layout.spread`` evens out
the rows first, which pays whenever a call costs more than moving its prompt.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame, functions as F, types as T

Model = Callable[[Sequence[str]], np.ndarray]
_FLAT = T.ArrayType(T.DoubleType())


def _predict(df: DataFrame, load: Callable[[], Model], out: str, prompt: str, batch_size: int) -> DataFrame:
    def make() -> Callable[[np.ndarray], np.ndarray]:
        model = load()

        def run(prompts: np.ndarray) -> np.ndarray:
            answer = np.asarray(model(list(np.atleast_1d(prompts))), dtype=np.float64)
            return answer.reshape(len(answer), -1)

        return run

    # Marked nondeterministic so that the optimizer neither repeats nor moves the call.
    call = predict_batch_udf(make, return_type=_FLAT, batch_size=batch_size)
    call = getattr(call, "asNondeterministic", lambda: call)()
    return df.withColumn(out, call(prompt))


def _cut(df: DataFrame, flat: str, width: int, vec: str) -> DataFrame:
    """Consecutive runs of ``width`` values to rows (part, vec)."""
    keys = [c for c in df.columns if c != flat]
    starts = F.sequence(F.lit(0), (F.size(flat) / width).cast("int") - 1)
    runs = F.transform(starts, lambda i: F.slice(flat, i * width + 1, F.lit(width)))
    return df.select(*keys, F.posexplode(runs).alias("part", vec))


def score_prompts(df: DataFrame, load: Callable[[], Model], prompt: str = "prompt", batch_size: int = 64) -> DataFrame:
    """Model returns [prompts, vocab]; adds ``logits`` of the last position."""
    return _predict(df, load, "logits", prompt, batch_size)


def layer_latents(
    df: DataFrame, load: Callable[[], Model], width: int, prompt: str = "prompt", batch_size: int = 64
) -> DataFrame:
    """Model returns [prompts, layers, width]; one row per prompt and layer with ``vec``."""
    flat = _predict(df, load, "_flat", prompt, batch_size)
    return _cut(flat, "_flat", width, "vec").withColumnRenamed("part", "layer")


def pooled_hidden(
    df: DataFrame, load: Callable[[], Callable[[str], np.ndarray]], width: int,
    prompt: str = "prompt", batch_size: int = 64,
) -> DataFrame:
    """Model returns [layers + 1, positions, width] for one prompt.

    Positions are averaged in the worker, so they never reach Spark.
    """
    def load_pooled() -> Model:
        hidden = load()
        return lambda prompts: np.stack([hidden(p).mean(axis=1) for p in prompts])

    return layer_latents(df, load_pooled, width, prompt, batch_size)


def component_logits(
    df: DataFrame, load: Callable[[], Model], components: Sequence[str], n_layers: int, width: int,
    prompt: str = "prompt", batch_size: int = 64,
) -> DataFrame:
    """Model returns [prompts, components, layers, vocab]; rows (component, layer, logits)."""
    flat = _predict(df, load, "_flat", prompt, batch_size)
    cut = _cut(flat, "_flat", width, "logits")
    name = F.get(F.lit(list(components)), F.floor(F.col("part") / n_layers).cast("int"))
    return cut.withColumn("component", name).withColumn("layer", F.col("part") % n_layers).drop("part")
