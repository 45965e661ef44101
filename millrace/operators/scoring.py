"""Scorers from outside: one answer at a time with a time limit, or batches."""

from __future__ import annotations

import importlib.util
import multiprocessing
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _serve(scorer, jobs, results) -> None:
    """A scoring process: one answer after the other, until it is told to end."""
    while (row := jobs.recv()) is not None:
        try:
            value = scorer(row)
            results.send(value if isinstance(value, dict) else float(value))
        except Exception:
            results.send(None)


class _Limited:
    """Calls a scorer in a process of its own, which is ended and started anew when a call takes too long."""

    def __init__(self, scorer, seconds: float):
        self.scorer, self.seconds, self.process = scorer, seconds, None

    def __call__(self, row: dict):
        """The value, or None where the scorer fails or takes too long."""
        if self.process is None:
            context = multiprocessing.get_context("fork")
            jobs, self.jobs = context.Pipe(False)
            self.results, results = context.Pipe(False)
            self.process = context.Process(target=_serve, args=(self.scorer, jobs, results), daemon=True)
            self.process.start()
        self.jobs.send(row)
        try:
            if self.results.poll(self.seconds):
                return self.results.recv()
        except EOFError:
            pass
        self.close()
        return None

    def close(self) -> None:
        if self.process is not None:
            self.process.kill()
            self.process.join()
            self.process = None


def timed(df: DataFrame, scorer: Callable[[dict], float | dict], inputs: list[str], seconds: float = 300.0, failed: float = 0.0, out: str = "score", extras: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with the scorer's value of each row's inputs; ``failed`` where it raises or takes too long. Rows run in parallel by partition.

    A scorer may return a dict with "score" and further values, of which those named in ``extras`` become columns (null where it
    fails). It runs in a process of its own, so the limit holds in any thread and for any code, also code that never returns.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType()), *[T.StructField(e, T.DoubleType()) for e in extras]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = _Limited(scorer, seconds)
        try:
            for pdf in batches:
                got = []
                for row in pdf[inputs].to_dict("records"):
                    value = call(row)
                    got.append({"score": failed} if value is None else value if isinstance(value, dict) else {"score": value})
                cols = {out: [float(g.get("score", failed)) for g in got]} | {e: [None if g.get(e) is None else float(g[e]) for g in got] for e in extras}
                yield pdf.assign(**cols)
        finally:
            call.close()

    return df.mapInPandas(run, schema)


def batched(df: DataFrame, scorer: Callable[[pd.DataFrame], pd.Series], inputs: list[str], out: str = "score") -> DataFrame:
    """``df`` with the values that a scorer gives for whole Arrow batches."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(**{out: scorer(pdf[inputs]).astype("float64").to_numpy()})

    return df.mapInPandas(run, schema)


def load(path: str, name: str):
    """An object of a Python file: a custom scorer, generator, sampler or reader."""
    spec = importlib.util.spec_from_file_location("plugin_" + str(abs(hash(path))), path)
    if spec is None or spec.loader is None:
        raise FileNotFoundError(path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return getattr(module, name)
