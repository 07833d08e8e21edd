"""A user's detector over tiles: any function from an Arrow batch to boxes, loaded once per worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from gridloom import constants as K
from gridloom.functions import boxes as B

#: From a batch of tiles to each tile's boxes as ``(x1, y1, x2, y2)``, in the order of the rows.
Detector = Callable[[pa.RecordBatch], Sequence[Sequence[Sequence[float]]]]
BOX = T.StructType([T.StructField("label", T.StringType()), *[T.StructField(c, T.DoubleType()) for c in B.CORNERS]])
_loaded: dict[str, Detector] = {}


def detect(tiles: DataFrame, load: Callable[[], Detector], name: str, out: str = "raw", keep: Sequence[str] | None = None, rows: int = 256) -> DataFrame:
    """``keep`` (all columns by default) and ``out``, the boxes of each tile as structs of label and corners.

    ``load`` runs once in a worker process and returns the detector; ``name`` tells detectors apart. The detector sees at most
    ``rows`` tiles at once with all their columns. A detector that answers for another number of tiles is an error.
    """
    kept = [c for c in (tiles.columns if keep is None else keep) if c != out]
    schema = T.StructType([*[tiles.schema[c] for c in kept], T.StructField(out, T.ArrayType(BOX))])
    kind = pa.list_(pa.struct([("label", pa.string()), *[(c, pa.float64()) for c in B.CORNERS]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _loaded:
            _loaded[name] = load()
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                part = batch.slice(start, rows)
                found = _loaded[name](part)
                if len(found) != part.num_rows:
                    raise ValueError(f"detector {name} answered for {len(found)} of {part.num_rows} tiles")
                boxes = [[{"label": K.BOX_LABEL, **dict(zip(B.CORNERS, map(float, b)))} for b in own] for own in found]
                yield pa.RecordBatch.from_arrays([*[part.column(part.schema.get_field_index(c)) for c in kept], pa.array(boxes, kind)], names=[*kept, out])

    return tiles.mapInArrow(run, schema)
