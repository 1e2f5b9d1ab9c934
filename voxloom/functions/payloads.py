"""Encode and decode sample members: PCM16 wav bytes and 1-D integer npy bytes."""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _wav(pcm: np.ndarray, sr: int) -> bytes:
    buffer = io.BytesIO()
    with wave.open(buffer, "wb") as out:
        out.setnchannels(1)
        out.setsampwidth(2)
        out.setframerate(int(sr))
        out.writeframes(np.asarray(pcm, dtype="<i2").tobytes())
    return buffer.getvalue()


@F.pandas_udf(T.BinaryType())
def wav_bytes(pcm: pd.Series, sr: pd.Series) -> pd.Series:
    """A mono wav file of 16-bit samples (see ``pcm16``)."""
    return pd.Series([None if p is None else _wav(p, r) for p, r in zip(pcm, sr)], dtype="object")


@F.pandas_udf(T.BinaryType())
def npy_bytes(codes: pd.Series) -> pd.Series:
    def encode(values) -> bytes | None:
        if values is None:
            return None
        buffer = io.BytesIO()
        np.save(buffer, np.asarray(values, dtype="<i4"), allow_pickle=False)
        return buffer.getvalue()

    return codes.map(encode)


def _signal(data: bytes | None) -> tuple[int | None, np.ndarray | None]:
    if data is None:
        return None, None
    try:
        with wave.open(io.BytesIO(data)) as source:
            if source.getsampwidth() != 2:
                return None, None
            pcm = np.frombuffer(source.readframes(source.getnframes()), dtype="<i2")
            channels = pcm.reshape(-1, source.getnchannels()).astype(np.float32) / np.float32(32768)
            return source.getframerate(), channels.mean(axis=1, dtype=np.float32)
    except (wave.Error, EOFError, ValueError):
        return None, None


def _codes(data: bytes | None) -> np.ndarray | None:
    if data is None:
        return None
    try:
        codes = np.load(io.BytesIO(data), allow_pickle=False)
    except (ValueError, EOFError, OSError):
        return None
    return codes.astype(np.int32) if codes.ndim == 1 and codes.dtype.kind in "iu" else None


SIGNAL = T.StructType([T.StructField("sr", T.IntegerType()), T.StructField("samples", T.ArrayType(T.FloatType()))])


@F.pandas_udf(SIGNAL)
def wav_signal(payload: pd.Series) -> pd.DataFrame:
    """struct(sr, samples): mono float samples; NULL fields for bytes that are no 16-bit wav."""
    signals = [_signal(data) for data in payload]
    return pd.DataFrame(
        {
            "sr": pd.array([r for r, _ in signals], dtype="Int32"),
            "samples": pd.Series([s for _, s in signals], dtype="object"),
        }
    )


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def npy_codes(payload: pd.Series) -> pd.Series:
    """Flat codes; NULL for bytes that are no 1-D integer array. Pickled content is never loaded."""
    return payload.map(_codes)


SAMPLE = T.StructType([T.StructField("codes", T.ArrayType(T.IntegerType())), *SIGNAL])


def sample_decoder(min_codes: int, max_codes: int | None = None, q: int = 16):
    """A function of (npy, wav) bytes to struct(codes, sr, samples), in one pass over the rows.

    The audio is decoded only if the codes are whole rows of ``q`` and their number is in range.
    """

    @F.pandas_udf(SAMPLE)
    def decode(npy: pd.Series, wav: pd.Series) -> pd.DataFrame:
        codes = [_codes(data) for data in npy]

        def wanted(c: np.ndarray | None) -> bool:
            rows, rest = divmod(0 if c is None else len(c), q)
            return c is not None and not rest and rows >= min_codes and (max_codes is None or rows <= max_codes)

        signals = [_signal(data) if wanted(c) else (None, None) for c, data in zip(codes, wav)]
        return pd.DataFrame(
            {
                "codes": pd.Series(codes, dtype="object"),
                "sr": pd.array([r for r, _ in signals], dtype="Int32"),
                "samples": pd.Series([s for _, s in signals], dtype="object"),
            }
        )

    return decode
