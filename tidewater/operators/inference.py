"""Model inference: a table function that appends a model's outputs to its input's fields.

A model is an ONNX file, run with onnxruntime where that is installed, or any Python
function from a matrix of float32 to a matrix of float32.  It runs in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from ..errors import SchemaError, TypeMismatch, UnknownModel
from ..plans import Relation
from ..types import Field, Schema


@dataclass(frozen=True)
class Model:
    """``run`` or ``path``; ``inputs`` and ``outputs`` with their declared types."""

    name: str
    inputs: Schema
    outputs: Schema
    path: str | None = None
    run: Callable[[np.ndarray], np.ndarray] | None = None

    def loaded(self) -> Callable[[np.ndarray], np.ndarray]:
        if self.run is not None:
            return self.run
        try:
            import onnxruntime
        except ImportError:
            raise UnknownModel(f"model {self.name} is an ONNX file, and onnxruntime is not installed") from None
        session = onnxruntime.InferenceSession(self.path, providers=["CPUExecutionProvider"])
        name = session.get_inputs()[0].name
        return lambda x: np.concatenate([o.reshape(len(x), -1) for o in session.run(None, {name: x})], axis=1)


def infer(rel: Relation, model: Model) -> Relation:
    """``rel`` with the model's outputs; its inputs must be fields that are NOT NULL and have the declared types."""
    for f in model.inputs.fields:
        have = rel.schema[f.name]
        if have.name != f.type.name:
            raise TypeMismatch(f"model {model.name} takes {f.name} as {f.type.name}, not {have.name}")
        if have.nullable:
            raise SchemaError(f"model {model.name} takes {f.name} NOT NULL only")
    outputs = tuple(Field(f.name, f.type.but(False)) for f in model.outputs.fields)
    schema = Schema(rel.schema.fields + outputs)  # raises if an output has the name of a field
    inputs, names = model.inputs.names, rel.schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = model.loaded()
        for batch in batches:
            x = np.stack([batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in inputs], axis=1).astype(np.float32)
            y = np.asarray(predict(x)).reshape(len(x), len(outputs)) if len(x) else np.zeros((0, len(outputs)), np.float32)
            made = [pa.array(y[:, k]).cast(pa.from_numpy_dtype(np.dtype("f8" if f.type.name == "FLOAT64" else "f4"))) for k, f in enumerate(outputs)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*names, *(f.name for f in outputs)])

    return Relation(rel.df.mapInArrow(run, schema.struct), schema)
