"""Signal, code and payload scalars over array and map columns; all JVM-side."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxloom.functions.hashing import md5_uniform

# Fixed values of the corpus format.
TOKEN_RATE = 12.5
QUANTIZERS = 16
MIN_RATE = 44100
AUDIO_EXTENSIONS = ("wav", "mp3", "flac", "ogg", "opus")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once per row.

    A column that a lambda captures may be inlined there by the optimizer and so be evaluated once
    per array element; a one-element array holds it instead.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def indices(n: Column) -> Column:
    """0 .. n-1, and the empty array for n <= 0 (a bare sequence would count down)."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def zeros(n: Column) -> Column:
    return F.array_repeat(F.lit(0.0).cast("float"), F.greatest(n, F.lit(0)).cast("int"))


def nonempty_payload(payload: Column | str) -> Column:
    """True for a payload that is neither NULL nor empty."""
    return F.coalesce(F.length(_col(payload)) > 0, F.lit(False))


def rate_skip_reason(sr: Column | str, sr_min: int = MIN_RATE) -> Column:
    return F.when(_col(sr) < F.lit(sr_min), F.lit("low_rate"))


def downmix(channels: Column | str) -> Column:
    """Mean over channels of an array of equally long channels."""
    def mean_at(c: Column, i: Column) -> Column:
        total = F.aggregate(c, F.lit(0.0), lambda acc, ch: acc + F.get(ch, i).cast("double"))
        return (total / F.size(c)).cast("float")

    n = lambda c: F.size(F.get(c, F.lit(0)))
    return bind(_col(channels), lambda c: F.transform(indices(n(c)), lambda i: mean_at(c, i)))


def pad_to(samples: Column | str, n: Column | int) -> Column:
    """Zeros on the right up to length ``n``; longer arrays are unchanged."""
    s = _col(samples)
    want = F.lit(n) if isinstance(n, int) else n
    return F.concat(s, zeros(want - F.size(s)))


def pad_edges(samples: Column | str, k: Column | int) -> Column:
    edge = zeros(F.lit(k) if isinstance(k, int) else k)
    return F.concat(edge, _col(samples), edge)


def min_code_count(seconds: float, token_rate: float = TOKEN_RATE) -> int:
    return int(token_rate * seconds)


def enough_codes(n: Column | str, min_s: float = 1.0) -> Column:
    return _col(n) >= F.lit(min_code_count(min_s))


def duration_skip_reason(n: Column | str, min_s: float = 1.0, max_s: float = 10.0) -> Column:
    inside = _col(n).between(min_code_count(min_s), min_code_count(max_s))
    return F.when(~inside, F.lit("duration"))


def mean_square(samples: Column | str) -> Column:
    s = _col(samples)
    total = F.aggregate(s, F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double"))
    return F.when(F.size(s) > 0, total / F.size(s))


def rms_db(samples: Column | str) -> Column:
    """Level in dB with a 1e-8 floor under the root."""
    return F.lit(20.0) * F.log10(F.sqrt(mean_square(samples) + F.lit(1e-8)))


def loud_enough_db(samples: Column | str, threshold: float = -40.0) -> Column:
    return rms_db(samples) >= F.lit(threshold)


def rms(samples: Column | str) -> Column:
    return F.sqrt(mean_square(samples))


def loud_enough_amp(samples: Column | str, threshold: float = 1e-4) -> Column:
    return rms(samples) >= F.lit(threshold)


def crop_start(n: Column | str, max_codes: int, seed: int, *key: Column | str) -> Column:
    """First kept code: 0 where nothing is cropped, else uniform in [0, n - max_codes)."""
    count = _col(n)
    drawn = F.floor(md5_uniform(seed, *key) * (count - F.lit(max_codes)))
    return F.when(count > max_codes, drawn).otherwise(F.lit(0)).cast("bigint")


def aligned_crop(
    codes: Column | str, audio: Column | str, sr: Column | str, max_s: float, seed: int, *key: Column | str
) -> Column:
    """Crop a code matrix and its audio to the same window.

    Returns struct(start, codes, audio); both arrays are whole where the clip is short enough.
    """
    c, a, rate = _col(codes), _col(audio), _col(sr)
    limit = min_code_count(max_s)
    n = F.size(c)
    start = crop_start(n, limit, seed, *key)
    per_code = rate / F.lit(TOKEN_RATE)
    first = (start * per_code).cast("int")
    last = ((start + limit) * per_code).cast("int")
    long = n > limit
    return F.struct(
        start.alias("start"),
        F.when(long, F.slice(c, (start + 1).cast("int"), F.lit(limit))).otherwise(c).alias("codes"),
        F.when(long, F.slice(a, first + 1, last - first)).otherwise(a).alias("audio"),
    )


def pcm16(samples: Column | str) -> Column:
    """Clip to [-1, 1], scale by 32767 in single precision, cut the fraction. A NaN sample is silence."""
    scale = F.lit(32767.0).cast("float")
    one = F.lit(1.0).cast("float")
    return F.transform(
        _col(samples),
        lambda v: (F.least(F.greatest(F.nanvl(v, F.lit(0.0).cast("float")), -one), one) * scale).cast("smallint"),
    )


def align_pair(a: Column | str, b: Column | str) -> tuple[Column, Column]:
    x, y = _col(a), _col(b)
    n = F.least(F.size(x), F.size(y))
    return F.slice(x, 1, n), F.slice(y, 1, n)


def mask_tail(samples: Column | str, length: Column | str) -> Column:
    zero = F.lit(0.0).cast("float")
    return bind(
        _col(length), lambda n: F.transform(_col(samples), lambda v, i: F.when(i < n, v).otherwise(zero))
    )


def weighted_sum(weights: dict[str, float]) -> Column:
    """Weighted total of named columns; a zero weight leaves its column out altogether."""
    terms = [F.lit(float(w)) * F.col(name) for name, w in weights.items() if w != 0]
    return reduce(lambda x, y: x + y, terms, F.lit(0.0))


def every_n(step: Column | str, n: int) -> Column:
    if n <= 0:
        raise ValueError("the cadence must be positive")
    s = _col(step)
    return (F.pmod(s, F.lit(n)) == 0) & (s > 0)


def pick_payload(members: Column | str, extensions: Sequence[str] = AUDIO_EXTENSIONS) -> tuple[Column, Column]:
    """(payload, extension) of the first extension present; both NULL where none is."""
    m = _col(members)
    payload = F.coalesce(*[F.try_element_at(m, F.lit(e)) for e in extensions])
    ext = F.coalesce(*[F.when(F.try_element_at(m, F.lit(e)).isNotNull(), F.lit(e)) for e in extensions])
    return payload, ext


def codes_skip_reason(codes: Column | str, q: int = QUANTIZERS) -> Column:
    c = _col(codes)
    return F.when(c.isNull(), F.lit("no_codes")).when(F.size(c) % q != 0, F.lit("bad_shape"))


def codes_matrix(codes: Column | str, q: int = QUANTIZERS) -> Column:
    """Rows of ``q`` codes; NULL where the length is not a multiple of ``q``."""

    def rows(c: Column) -> Column:
        n = (F.size(c) / F.lit(q)).cast("int")
        cut = F.transform(indices(n), lambda i: F.slice(c, i * q + 1, F.lit(q)))
        return F.when(F.size(c) % q == 0, cut)

    return bind(_col(codes), rows)
