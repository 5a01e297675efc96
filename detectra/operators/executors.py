"""External solvers: a batch of designs in, the batch with an outcome out."""

from __future__ import annotations

import os
import shlex
import subprocess
import tempfile
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Executor(ABC):
    """``run`` gets designs and returns them with an outcome; an empty frame says that the batch failed."""

    @abstractmethod
    def run(self, samples: DataFrame) -> DataFrame: ...


class PythonExecutor(Executor):
    """A function of one row, run on the executors.  If any row raises, the whole batch is empty."""

    def __init__(self, solver: Callable, outcome_col: str = "Signal"):
        self.solver, self.outcome_col = solver, outcome_col

    def run(self, samples: DataFrame) -> DataFrame:
        solver, name = self.solver, self.outcome_col
        fields = [*samples.drop(name).schema.fields, T.StructField(name, T.DoubleType())]
        tried = T.StructType([*fields, T.StructField("__failed", T.BooleanType())])
        names = [f.name for f in fields]

        def solve(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
            for pdf in batches:
                values, failed = [], []
                for _, row in pdf.iterrows():
                    try:
                        v = solver(row)
                        values.append(None if v is None else float(v))
                        failed.append(False)
                    except Exception:  # noqa: BLE001 - whatever a solver raises fails its batch
                        values.append(None)
                        failed.append(True)
                yield pdf.assign(**{name: pd.Series(values, index=pdf.index, dtype=float), "__failed": failed})[[*names, "__failed"]]

        from ..sources.checkpoint import cut

        out = cut(samples.mapInPandas(solve, tried))
        if not out.filter("__failed").isEmpty():
            return out.filter(F.lit(False)).drop("__failed")
        return out.drop("__failed").withColumn(name, F.when(~F.isnan(name), F.col(name)))


class CLIExecutor(Executor):
    """A command with {input} and {output} CSV paths, run without a shell.

    The batch is one task: the solver sees one file.  A temporary folder of the task's own holds the
    files, so an old output is never read.  A failing exit, a missing or unreadable output, or one
    that lacks input columns and has another number of rows, is an empty batch; with the same number
    of rows missing inputs are added by position.
    """

    def __init__(self, command_template: str, input_path: str = "temp_in.csv", output_path: str = "temp_out.csv", outcome_col: str = "Signal"):
        self.command_template, self.outcome_col = command_template, outcome_col
        self.input_name, self.output_name = os.path.basename(input_path), os.path.basename(output_path)

    def command(self, source: str, target: str) -> list[str]:
        return shlex.split(self.command_template.format(input=source, output=target))

    def solve(self, pdf: pd.DataFrame) -> pd.DataFrame:
        with tempfile.TemporaryDirectory() as d:
            source, target = os.path.join(d, self.input_name), os.path.join(d, self.output_name)
            pdf.to_csv(source, index=False)
            try:
                subprocess.run(self.command(source, target), shell=False, check=True)
            except subprocess.CalledProcessError:
                return pd.DataFrame()
            try:
                out = pd.read_csv(target)
            except (OSError, ValueError):
                return pd.DataFrame()
        missing = [c for c in pdf.columns if c not in out.columns]
        if missing and len(out) != len(pdf):
            return pd.DataFrame()
        for c in missing:
            out[c] = pdf[c].to_numpy()
        return out

    def run(self, samples: DataFrame) -> DataFrame:
        names, outcome = samples.columns, self.outcome_col
        schema = T.StructType([*samples.drop(outcome).schema.fields, T.StructField(outcome, T.DoubleType())])
        wanted = [f.name for f in schema.fields]

        def task(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
            parts = list(batches)
            if parts:
                out = self.solve(pd.concat(parts, ignore_index=True)[names])
                if len(out):
                    if outcome not in out.columns:
                        raise ValueError(f"the solver's output lacks {outcome!r}")
                    yield out[wanted].assign(**{outcome: pd.to_numeric(out[outcome], errors="coerce")})

        from ..sources.checkpoint import cut

        out = cut(samples.coalesce(1).mapInPandas(task, schema))
        return out.withColumn(outcome, F.when(~F.isnan(outcome), F.col(outcome)))


class MatlabExecutor(CLIExecutor):
    """Runs a MATLAB function of the two paths."""

    def __init__(self, wrapper_name: str, **kwargs):
        name = wrapper_name.removesuffix(".m")
        super().__init__(f"matlab -batch \"{name}('{{input}}','{{output}}')\" -nosplash -nodesktop", **kwargs)
