"""Features of sound from its samples: frames that overlap, a window function and a Fourier
transform over arrays, in Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import scalars as S

#: Samples of a frame and between frames, loudness below which a frame is silent, the
#: band of speech, the share of energy below the rolloff, and the pitches that count as voice.
FRAME, HOP, SILENCE = 2048, 1024, 0.005
SPEECH_HZ, ROLLOFF, VOICE_HZ = (300.0, 3400.0), 0.85, (60.0, 500.0)
#: Frames transformed at once.
BLOCK = 256
FEATURES = ("duration_sec", "rms", "dynamic_range", "centroid_hz", "flatness", "rolloff_hz", "zero_cross_rate", "speech_band_ratio", "voicing", "onset_rate", "activity")
#: Digits that features are rounded to, halves up.
DIGITS = dict(zip(FEATURES, (2, 3, 3, 0, 3, 0, 0, 3, 3, 2, 3)))


def _voicing(frames: np.ndarray, rate: float) -> np.ndarray:
    """The strongest autocorrelation at the lags of voices, over the energy, by the transform of
    the frames' power spectra."""
    n = frames.shape[1]
    low, high = int(rate // VOICE_HZ[1]), min(n - 1, int(rate // VOICE_HZ[0]))
    if high <= low:
        return np.zeros(len(frames))
    power = np.abs(np.fft.rfft(frames, 2 * n, axis=1)) ** 2
    lags = np.fft.irfft(power, axis=1)[:, low : high + 1]
    return np.clip(np.maximum(lags.max(axis=1), 0) / (frames * frames).sum(axis=1), 0, 1)


def measure(samples: np.ndarray, rate: float, frame: int = FRAME, hop: int = HOP) -> list[float]:
    """``FEATURES`` of one signal, not rounded. Frames that the samples do not fill are left out."""
    count = max(0, (len(samples) - frame) // hop + 1)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(frame) / (frame - 1))
    bins, hz = frame // 2, np.arange(frame // 2) * rate / frame
    speech = (hz >= SPEECH_HZ[0]) & (hz <= SPEECH_HZ[1])
    sums, spectral, crossings, loudness, flux, before = np.zeros(5), 0, 0, [], [], None
    for at in range(0, count, BLOCK):
        frames = np.lib.stride_tricks.sliding_window_view(samples, frame)[at * hop : (min(count, at + BLOCK) - 1) * hop + 1 : hop]
        crossings += int(((frames[:, 1:] >= 0) != (frames[:, :-1] >= 0)).sum())
        rms = np.sqrt((frames * frames).mean(axis=1))
        loudness.append(rms)
        mags = np.abs(np.fft.rfft(frames * window, axis=1))[:, :bins]
        total = mags.sum(axis=1)
        heard = (rms >= SILENCE) & (total > 0)
        # Flux counts between frames that follow each other and are both heard.
        former = np.vstack([np.zeros((1, bins)) if before is None else before, mags[:-1]])
        follows = heard & np.concatenate([[before is not None], heard[:-1]])
        flux.append((np.maximum(mags - former, 0).sum(axis=1) / np.where(total > 0, total, 1))[follows])
        before = mags[-1:] if heard[-1] else None
        mags, total = mags[heard], total[heard]
        if len(mags):
            flat = np.exp(np.log(mags + 1e-9).mean(axis=1)) / (total / bins)
            # Equal sums in another order may miss the share by a last digit.
            reached = np.cumsum(mags, axis=1) >= ROLLOFF * total[:, None] * (1 - 1e-12)
            parts = ((mags @ hz) / total, np.clip(flat, 0, 1), hz[reached.argmax(axis=1)], mags[:, speech].sum(axis=1) / total, _voicing(frames[heard], rate))
            sums += [p.sum() for p in parts]
            spectral += len(mags)
    rms = np.concatenate(loudness) if loudness else np.zeros(0)
    loud, change = np.sort(rms[rms >= SILENCE]), np.concatenate(flux) if flux else np.zeros(0)
    onsets = 0
    if len(change) > 4:
        high = change[1:-1] > change.mean() + change.std()
        onsets = int((high & (change[1:-1] >= change[:-2]) & (change[1:-1] > change[2:])).sum())
    centroid, flatness, rolloff, band, voicing = sums / max(1, spectral)
    spread = loud[int(len(loud) * 0.9)] - loud[int(len(loud) * 0.1)] if len(loud) else 0.0
    duration = len(samples) / rate
    mean = loud.mean() if len(loud) else 0.0
    return [
        duration, min(1.0, mean), min(1.0, max(0.0, spread)), centroid, flatness, rolloff, crossings / max(1e-6, duration), band, voicing,
        onsets / max(1e-6, spectral * hop / rate), len(loud) / len(rms) if len(rms) else 0.0,
    ]


def encoded(df: DataFrame, samples: str = "samples", rate: float = 44_100.0, frame: int = FRAME, hop: int = HOP) -> DataFrame:
    """``df`` with the ``FEATURES`` of the mono signal in ``samples``, values around zero at ``rate`` Hz.

    A null signal has null features; null and non-finite samples count as zero; one shorter than
    a frame has a duration and zeros. Each row is measured by itself, in blocks of frames.
    """

    @F.arrow_udf("array<double>")
    def features(column: pa.Array) -> pa.Array:
        out = []
        for signal in column:
            x = signal.values
            out.append(None if x is None else measure(np.nan_to_num(x.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False), nan=0.0, posinf=0.0, neginf=0.0), rate, frame, hop))
        return pa.array([None if f is None else [float(x) for x in f] for f in out], pa.list_(pa.float64()))

    found = df.withColumn("__features", features(F.col(samples).cast("array<double>")))
    return found.withColumns({n: S.half_up(F.get("__features", F.lit(i)), DIGITS[n]) for i, n in enumerate(FEATURES)}).drop("__features")
