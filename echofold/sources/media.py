"""Frame hashes and audio fingerprints of media files, by external programs on the executors.

A row that fails does not fail the job: it has a status and a message instead of
a result, unless ``fail_fast`` is set.  There are two ways to stop:

* ``Extractor.cancel_file``: once a file of that name is there (on a file system
  that all executors share), rows end as ``Cancelled``.  It is looked for before
  each read of a program's output;
* ``cancellable`` and ``cancel``: the jobs under a tag are cancelled.

Either way, and after any error, the programs are killed; a program whose worker
is killed dies with it.
"""

from __future__ import annotations

import ctypes
import os
import select
import signal
import subprocess
import sys
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..params import AUDIO_CHANNELS, AUDIO_SAMPLE_RATE, SAMPLE_BYTES, SAMPLE_FPS, SAMPLE_H, SAMPLE_W

#: Bytes of a program's error output that a message keeps.
_KEPT = 128 * 1024
_BLOCK = 64 * 1024
#: Seconds between two looks at the cancel file while a program is silent.
_LOOK = 0.2


class ExtractError(Exception):
    """A file that could not be extracted: ``status`` is one of the kinds below, the text says why."""

    KINDS = ("Spawn", "Io", "Cancelled", "NonZeroExit", "Truncated", "Parse", "NoFingerprint")

    def __init__(self, status: str, message: str):
        super().__init__(message)
        self.status = status


@contextmanager
def cancellable(spark: SparkSession, tag: str) -> Iterator[None]:
    """Jobs that this thread starts inside carry the tag."""
    spark.sparkContext.addJobTag(tag)
    try:
        yield
    finally:
        spark.sparkContext.removeJobTag(tag)


def cancel(spark: SparkSession, tag: str) -> None:
    """Cancel all running jobs with the tag, whichever thread started them."""
    spark.sparkContext.cancelJobsWithTag(tag)


def _die_with_parent() -> None:
    """In a new program: a kill signal when the worker ends, however it ends (Linux)."""
    if sys.platform == "linux":
        ctypes.CDLL(None).prctl(1, signal.SIGKILL)


def exit_message(tool: str, code: int, said: str) -> str:
    how = f"exit status: {code}" if code >= 0 else f"signal: {-code}"
    return f"{tool} exit {how}" + (f": {said}" if said else "")


@contextmanager
def _program(args: list[str], **kw):
    """A running program whose error output goes to a file, so that it can never block; killed on the way out."""
    with tempfile.TemporaryFile() as errors:
        try:
            p = subprocess.Popen(args, stdout=subprocess.PIPE, stderr=errors, preexec_fn=_die_with_parent, **kw)
        except OSError as e:
            raise ExtractError("Spawn", f"spawn process: {e}") from e

        def said() -> str:
            errors.seek(0)
            return errors.read(_KEPT).decode("utf-8", "replace").strip()

        try:
            yield p, said
        finally:
            p.stdout.close()
            if p.poll() is None:
                p.kill()
            p.wait()


def hash_frames(data: bytes) -> list[int]:
    """Signed 64-bit frame hashes of raw gray frames."""
    if len(data) % SAMPLE_BYTES:
        raise ExtractError("Truncated", "ffmpeg output truncated mid-frame")
    pixels = np.frombuffer(data, np.uint8).reshape(-1, SAMPLE_H, SAMPLE_W)
    bits = (pixels[:, :, :-1] > pixels[:, :, 1:]).reshape(len(pixels), 64)
    return np.packbits(bits, axis=1, bitorder="little").view("<i8")[:, 0].tolist()


def parse_fingerprint_line(text: str) -> list[int]:
    """Sub-fingerprints, as unsigned 32-bit values, from the last FINGERPRINT= line of a program's output."""
    lines = [x.removeprefix("FINGERPRINT=") for x in text.splitlines() if x.startswith("FINGERPRINT=")]
    if not lines:
        raise ExtractError("NoFingerprint", "fpcalc produced no fingerprint")
    out = []
    for part in filter(None, map(str.strip, lines[-1].split(","))):
        digits = part[1:] if part[0] in "+-" else part
        if not (digits.isascii() and digits.isdigit()) or not -(2**63) <= int(part) < 2**63:
            raise ExtractError("Parse", f"parse fingerprint '{part}'")
        out.append(int(part) & 0xFFFFFFFF)
    return out


@dataclass(frozen=True)
class Extractor:
    ffmpeg_bin: str = "ffmpeg"
    fpcalc_bin: str = "fpcalc"
    cancel_file: str | None = None

    def _go_on(self) -> None:
        if self.cancel_file and os.path.exists(self.cancel_file):
            raise ExtractError("Cancelled", "cancelled")

    def _read(self, p: subprocess.Popen) -> bytes:
        """What a program has put out by now, up to a block; waits in short steps, looking whether to go on."""
        while True:
            self._go_on()
            if not self.cancel_file or select.select([p.stdout], [], [], _LOOK)[0]:
                return p.stdout.read1(_BLOCK)

    def _input(self, path: str, start: float, window: int) -> list[str]:
        # seeking before the input is fast and a little inexact, alike for all windows of a file
        return [self.ffmpeg_bin, "-nostdin", "-v", "error", "-nostats", "-ss", f"{start:.3f}", "-t", str(window), "-i", path]

    def frame_hashes(self, path: str, start: float, window: int) -> list[int]:
        """Hashes at 6 frames a second of a window of a video."""
        filters = f"fps={SAMPLE_FPS},scale={SAMPLE_W}:{SAMPLE_H},format=gray"
        args = [*self._input(path, start, window), "-vf", filters, "-an", "-f", "rawvideo", "-pix_fmt", "gray", "pipe:1"]
        with _program(args, stdin=subprocess.DEVNULL) as (p, said):
            data = bytearray()
            try:
                while block := self._read(p):
                    data += block
            except OSError as e:
                raise ExtractError("Io", f"read output: {e}") from e
            if code := p.wait():
                raise ExtractError("NonZeroExit", exit_message("ffmpeg", code, said()))
        return hash_frames(bytes(data))

    def audio_fingerprint(self, path: str, start: float, window: int) -> list[int]:
        """Sub-fingerprints of a window of a file's sound. The decoder's failure is reported before the other program's."""
        args = [*self._input(path, start, window), "-vn", "-ac", str(AUDIO_CHANNELS), "-ar", str(AUDIO_SAMPLE_RATE), "-f", "wav", "pipe:1"]
        with _program(args, stdin=subprocess.DEVNULL) as (decoder, decoder_said):
            with _program([self.fpcalc_bin, "-raw", "-length", "0", "-"], stdin=decoder.stdout) as (p, said):
                decoder.stdout.close()  # so that the decoder notices if the other one ends
                try:
                    text = b"".join(iter(lambda: self._read(p), b"")).decode("utf-8")
                except (OSError, UnicodeDecodeError) as e:
                    raise ExtractError("Io", f"read output: {e}") from e
                code, first = p.wait(), decoder.wait()
                if first:
                    raise ExtractError("NonZeroExit", exit_message("ffmpeg", first, decoder_said()))
                if code:
                    raise ExtractError("NonZeroExit", exit_message("fpcalc", code, said()))
        return parse_fingerprint_line(text)


def _extract(files: DataFrame, method: str, out: str, extractor: Extractor, window: int, partitions: int | None, fail_fast: bool) -> DataFrame:
    """One file is seconds of work, so files are dealt out evenly first."""
    rows = files.select(F.col("path"), F.col("start_secs").cast("double") if "start_secs" in files.columns else F.lit(0.0).alias("start_secs"))
    rows = rows.repartition(partitions) if partitions else rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        work = getattr(extractor, method)
        for pdf in batches:
            for path, start in zip(pdf.path, pdf.start_secs, strict=True):
                value, status, message = None, "Ok", None
                try:
                    value = work(path, start, window)
                except ExtractError as e:
                    if fail_fast:
                        raise
                    status, message = e.status, str(e)
                yield pd.DataFrame({"path": [path], "start_secs": [start], out: pd.Series([value], dtype=object), "status": [status], "message": [message]})

    return rows.mapInPandas(run, f"path string, start_secs double, {out} array<long>, status string, message string")


def read_frame_hashes(files: DataFrame, *, extractor: Extractor = Extractor(), window_secs: int = 60, partitions: int | None = None, fail_fast: bool = False) -> DataFrame:
    """(path, start_secs, hashes, status, message) for (path[, start_secs]) rows."""
    return _extract(files, "frame_hashes", "hashes", extractor, window_secs, partitions, fail_fast)


def read_audio_fingerprints(files: DataFrame, *, extractor: Extractor = Extractor(), window_secs: int = 60, partitions: int | None = None, fail_fast: bool = False) -> DataFrame:
    """(path, start_secs, fps, status, message) for (path[, start_secs]) rows."""
    return _extract(files, "audio_fingerprint", "fps", extractor, window_secs, partitions, fail_fast)
