"""A user's function over rows, with whole other tables at hand."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeplane.plans.storage import BROADCAST_ROWS


class RowKernel:
    """Runs fn(batch, tables, **uniforms) over the rows of an input; it gives one output row per row, as a pandas frame.

    inputs: tables by name that the function may read whole. They are broadcast, so each may have BROADCAST_ROWS rows.
    lookups: (table, column) by name, for tables of any size of which a row needs only one row: the table's row whose column
    equals the row's is joined, its columns named <name>_<column>; they are null where there is none, and a table with
    several such rows is refused. uniforms are numbers or lists of 2 to 4 numbers; others are refused.
    """

    def __init__(self, fn: Callable[..., pd.DataFrame], outputs: str, inputs: Mapping[str, DataFrame] | None = None, debug: bool = False, lookups: Mapping[str, tuple[DataFrame, str]] | None = None, **uniforms) -> None:
        for k, v in uniforms.items():
            numbers = v if isinstance(v, (list, tuple)) else [v]
            if isinstance(v, (list, tuple)) and not 2 <= len(v) <= 4 or not all(isinstance(x, (int, float)) for x in numbers):
                raise ValueError(f"Invalid uniform {k}: {v!r}. Must be a number or 2 to 4 numbers.")
        self.fn, self.outputs, self.inputs, self.uniforms, self.debug = fn, outputs, dict(inputs or {}), uniforms, debug
        self.lookups = dict(lookups or {})

    def bind(self, **tables: DataFrame) -> RowKernel:
        """The kernel with other tables, such as outputs of other kernels. In debug mode, row counts must stay the same."""
        if self.debug:
            for k, t in tables.items():
                if k in self.inputs and (a := self.inputs[k].count()) != (b := t.count()):
                    raise ValueError(f"Cannot bind {k}: Size mismatch ({a} and {b})")
        lookups = {k: (tables[k], on) if k in tables else (t, on) for k, (t, on) in self.lookups.items()}
        inputs = {**self.inputs, **{k: t for k, t in tables.items() if k not in lookups}}
        return RowKernel(self.fn, self.outputs, inputs, self.debug, lookups, **self.uniforms)

    def tables(self) -> dict[str, DataFrame]:
        return {**self.inputs, **{k: t for k, (t, _) in self.lookups.items()}}

    def compute(self, rows: DataFrame) -> DataFrame:
        held = {}
        for k, t in self.inputs.items():
            got = t.limit(BROADCAST_ROWS + 1).toPandas()
            if len(got) > BROADCAST_ROWS:
                raise ValueError(f"Table {k} has more than {BROADCAST_ROWS} rows; join it instead")
            held[k] = got
        shared = rows.sparkSession.sparkContext.broadcast(held)
        for name, (t, on) in self.lookups.items():
            if t.groupBy(on).count().where(F.col("count") > 1).limit(1).count():
                raise ValueError(f"Table {name} has several rows of one {on}")
            t = t.select(*(F.col(c).alias(f"{name}_{c}") for c in t.columns))
            rows = rows.join(t, rows[on] == t[f"{name}_{on}"], "left")
        fn, uniforms = self.fn, self.uniforms

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = fn(batch, shared.value, **uniforms)
                if len(out) != len(batch):
                    raise ValueError(f"The kernel gave {len(out)} rows for {len(batch)}")
                yield out

        return rows.mapInPandas(run, self.outputs)


def wire(steps: Mapping[str, tuple[RowKernel, DataFrame]]) -> dict[str, DataFrame]:
    """Runs kernels one after another, wired by name: (kernel, its rows) by name, and each kernel's output by that name.

    A kernel's table that is named like an earlier kernel takes that kernel's output; else, one named like a table of an
    earlier kernel takes that table. Either must have as many rows as the table it stands for, or the wiring is refused.
    """
    made: dict[str, DataFrame] = {}
    seen: dict[str, tuple[str, DataFrame]] = {}
    for name, (kernel, rows) in steps.items():
        bound = {}
        for table, own in kernel.tables().items():
            kind, source = ("output", (table, made[table])) if table in made else ("data", seen.get(table))
            if source is None:
                seen[table] = (name, own)
                continue
            if source[1] is not own and (a := source[1].count()) != (b := own.count()):
                raise ValueError(f'Cannot bind {kind} table "{table}" from "{source[0]}" to "{name}": Size mismatch ({source[0]}: {a}, {name}: {b})')
            bound[table] = source[1]
        made[name] = kernel.bind(**bound).compute(rows)
    return made
