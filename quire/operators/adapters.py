"""The contract of a recogniser: image bytes in, one prediction record a sample out.

An adapter is made once a Python worker and maps an image's bytes to text. What it raises becomes a record with that
status and no text, so that a bad line costs a line. Failures of the infrastructure (timeouts, crashes) are tried again; what was read isn't.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame

from quire.operators import images
from quire.sources.schemas import PREDICTIONS


class Adapter(Protocol):
    def read(self, content: bytes) -> str: ...


class Truncated(Exception):
    """The output limit was reached."""


class StubAdapter:
    """Reads the lines that `images.drawn` draws. A stand-in for a model, which has no weights and needs no device."""

    def read(self, content: bytes) -> str:
        image = images.decode_png(content)
        if image is None:
            raise ValueError("not an image")
        return images.read_back(image)


RUN = ("run_id", "model_id", "model_revision", "adapter_version", "prompt_hash", "config_hash")


def recognise(files: DataFrame, make: Callable[[], Adapter], run: dict[str, str], retries: int = 1) -> DataFrame:
    """Predictions of sample_id, content (null: the file is missing): a record an attempt."""
    names = [c.split()[0] for c in PREDICTIONS.split(", ")]

    def attempt(adapter: Adapter, content: bytes | None) -> tuple[str, str]:
        try:
            return ("", "missing") if content is None else (adapter.read(content), "success")
        except Truncated:
            return "", "truncated"
        except TimeoutError:
            return "", "timeout"
        except Exception:  # noqa: BLE001
            return "", "crash"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        adapter = make()
        for batch in batches:
            rows = []
            for sample, content in zip(batch.column("sample_id").to_pylist(), batch.column("content").to_pylist(), strict=True):
                for k in range(retries + 1):
                    began = time.monotonic()
                    text, status = attempt(adapter, content)
                    size = images.struct.unpack_from(">II", content, 16) if content and content[:8] == images.SIGNATURE else (None, None)
                    rows.append({"sample_id": sample, "raw_prediction": text, "status": status, "retry_count": k, "runtime_ms": int(1000 * (time.monotonic() - began)), "peak_vram_mb": None, "input_width": size[0], "input_height": size[1], **{c: run.get(c) for c in RUN}})
                    if status not in ("timeout", "crash"):
                        break
            kinds = {"runtime_ms": pa.int64(), "peak_vram_mb": pa.int64(), "input_width": pa.int32(), "input_height": pa.int32(), "retry_count": pa.int32()}
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds.get(c, pa.string())) for c in names], names)

    return files.select("sample_id", "content").mapInArrow(work, PREDICTIONS)
