"""Signal measurements on one item's samples: numpy in, numbers out. None where the evidence is too weak."""

from __future__ import annotations

import numpy as np

#: Length of an envelope window, and the poles of the low and the high band.
WINDOW_MS, LOW_HZ, HIGH_HZ = 23.0, 200.0, 4000.0
FFT, HOP = 2048, 512
BANDS, BAND_LOW, BAND_HIGH = 40, 30.0, 8000.0
MIN_BPM, MAX_BPM, LIKELY_BPM, TIGHT = 60.0, 200.0, 120.0, 400.0
CHROMA_FFT, CHROMA_HOP = 8192, 4096
KERNEL, SECTION_S = 32, 8.0
TARGET_LUFS = -14.0
SEGMENT = 343_980
# Krumhansl's key profiles.
MAJOR = (6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88)
MINOR = (6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17)
NAMES = ("C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B")
#: Share of the spectrum before, decay of its peak a frame, and the least peak.
SPECTRUM_SMOOTH, SPECTRUM_DECAY, SPECTRUM_FLOOR = 0.55, 0.985, 5e-4


def _one_pole(x: np.ndarray, hz: float, rate: int) -> np.ndarray:
    """y += a (x - y), by blocks: within a block the recurrence is a product with a small triangle of powers."""
    a = 1 - np.exp(-2 * np.pi * hz / rate)
    n = 64
    k = np.arange(n)
    powers = np.tril(a * (1 - a) ** np.maximum(k[:, None] - k[None, :], 0))
    # no BLAS: its threads would be as many as cores in every task
    y = np.einsum("bj,ij->bi", np.pad(x, (0, -len(x) % n)).reshape(-1, n), powers)
    decay, carry = (1 - a) ** (k + 1), 0.0
    for row in y:
        row += carry * decay
        carry = row[-1]
    return y.ravel()[: len(x)]


def envelopes(x: np.ndarray, rate: int) -> np.ndarray:
    """Root mean squares of the whole, the low and the high band per window, over the largest of all three."""
    x = np.asarray(x, float)
    n = max(1, round(rate * WINDOW_MS / 1000))
    bands = np.stack([x, _one_pole(x, LOW_HZ, rate), x - _one_pole(x, HIGH_HZ, rate)])
    whole = bands[:, : len(x) // n * n].reshape(3, -1, n)
    rms = np.sqrt((whole**2).mean(2))
    return rms / top if rms.size and (top := rms.max()) > 0 else rms


def onset_envelope(x: np.ndarray, rate: int) -> np.ndarray:
    """Half-wave flux of logarithmic bands, less its local mean, scaled to unit deviation."""
    if len(x) < FFT:
        return np.zeros(0)
    frames = np.lib.stride_tricks.sliding_window_view(np.asarray(x, float), FFT)[::HOP]
    spectrum = np.abs(np.fft.rfft(frames * np.hanning(FFT + 1)[:-1], axis=1))
    edges = np.geomspace(BAND_LOW, min(BAND_HIGH, rate / 2), BANDS + 1) * FFT / rate
    edges = np.minimum(np.maximum.accumulate(edges.astype(int) + np.arange(BANDS + 1) * 0), spectrum.shape[1] - 1)
    for i in range(1, len(edges)):
        edges[i] = max(edges[i], edges[i - 1] + 1)
    edges = edges[edges <= spectrum.shape[1]]
    bands = np.log1p(np.add.reduceat(spectrum, edges[:-1], axis=1))
    flux = np.maximum(np.diff(bands, axis=0, prepend=bands[:1]), 0).sum(1)
    half = max(1, round(1.5 * rate / HOP / 2))
    total = np.concatenate(([0], np.cumsum(flux)))
    lo, hi = np.maximum(np.arange(len(flux)) - half, 0), np.minimum(np.arange(len(flux)) + half + 1, len(flux))
    flux = np.maximum(flux - (total[hi] - total[lo]) / (hi - lo), 0)
    return flux / sd if (sd := flux.std()) > 0 else flux


def period(envelope: np.ndarray, fps: float) -> tuple[float, float] | None:
    """(frames a beat, confidence): autocorrelation over the overlap, weighted towards a likely tempo; the shortest of equal ones.

    None for envelopes shorter than twice the longest beat, and for silence.
    """
    e = np.asarray(envelope, float)
    most = int(np.ceil(fps * 60 / MIN_BPM))
    energy = float((e * e).sum())
    if len(e) < 2 * most or energy <= 1e-9:
        return None
    lags = np.arange(max(2, int(fps * 60 / MAX_BPM)), min(most, len(e) - 1) + 1)
    r = np.array([float((e[:-k] * e[k:]).mean()) for k in lags]) * len(e) / energy
    k = int(np.argmax(r * np.exp(-0.5 * np.log2(60 * fps / lags / LIKELY_BPM) ** 2)))
    return float(lags[k]), float(np.clip(r[k], 0.0, 1.0))


def beat_grid(envelope: np.ndarray, beat: float) -> list[int]:
    """Dynamic program over frames: strong onsets, even spacing. No beats under two frames a beat.

    Each frame follows its best predecessor between half and twice a beat before it, the earliest of equal ones; only frames
    without any begin a chain. The chain ends at the best frame of the last two beats, the last of equal ones.
    """
    if beat < 2:
        return []
    lo, hi = max(1, int(beat / 2 + 0.5)), int(2 * beat + 0.5)
    gaps = np.arange(hi, lo - 1, -1)
    cost = -TIGHT * np.log(gaps / beat) ** 2
    score, back = np.asarray(envelope, float).copy(), np.full(len(envelope), -1)
    for t in range(lo, len(score)):
        own = slice(max(0, hi - t), None)
        options = score[t - gaps[own]] + cost[own]
        k = int(np.argmax(options))
        score[t] += options[k]
        back[t] = t - gaps[own][k]
    tail = score[-hi:]
    at, out = len(score) - 1 - int(np.argmax(tail[::-1])) if len(score) else -1, []
    while at >= 0:
        out.append(int(at))
        at = back[at]
    return out[::-1]


def beats(x: np.ndarray, rate: int) -> tuple[float, float, np.ndarray] | None:
    """(tempo, confidence, beat times in ms); None under 10 s, in silence, or outside 60 to 200."""
    if len(x) < 10 * rate or not np.any(x):
        return None
    envelope = onset_envelope(x, rate)
    if (found := period(envelope, rate / HOP)) is None:
        return None
    ms = (np.array(beat_grid(envelope, found[0])) * HOP + FFT / 2) / rate * 1000
    if len(ms) < 2:
        return None
    bpm = 60000 / float(np.median(np.diff(ms)))
    return (bpm, found[1], ms) if MIN_BPM <= bpm <= MAX_BPM else None


def chromagram(x: np.ndarray, rate: int) -> tuple[np.ndarray, np.ndarray]:
    """(frame numbers, unit-sum pitch classes) of the frames that aren't silent."""
    if len(x) < CHROMA_FFT:
        return np.zeros(0, int), np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(np.asarray(x, float), CHROMA_FFT)[::CHROMA_HOP]
    hz = np.fft.rfftfreq(CHROMA_FFT, 1 / rate)
    use = np.flatnonzero((hz >= 65) & (hz <= 2000))
    classes = np.round(12 * np.log2(hz[use] / 440) + 69).astype(int) % 12
    spectrum = np.abs(np.fft.rfft(frames * np.hanning(CHROMA_FFT + 1)[:-1], axis=1))[:, use]
    out = np.stack([spectrum[:, classes == c].sum(1) for c in range(12)], 1)
    loud = np.flatnonzero(out.sum(1) > 1e-6)
    return loud, out[loud] / out[loud].sum(1, keepdims=True)


def key_of(chroma: np.ndarray) -> tuple[int, bool, float] | None:
    """(tonic, major, confidence): the profile that correlates best, if by a margin of 0.05."""
    if np.ptp(chroma) < 1e-9:
        return None
    scores = [(float(np.corrcoef(chroma, np.roll(p, t))[0, 1]), -t, m) for t in range(12) for m, p in ((True, MAJOR), (False, MINOR))]
    first, second = sorted(scores, reverse=True)[:2]
    return (-first[1], first[2], first[0] - second[0]) if first[0] - second[0] >= 0.05 else None


def novelty(frames: np.ndarray) -> np.ndarray:
    """Checkerboard novelty along the diagonal of the cosine self-similarity; only a band of it is formed."""
    n, size = len(frames), 2 * KERNEL
    k = np.arange(size) - KERNEL + 0.5
    gauss = np.exp(-(k[:, None] ** 2 + k[None, :] ** 2) / (2 * (KERNEL / 2) ** 2))
    kernel = gauss * np.sign(k[:, None]) * np.sign(k[None, :])
    unit = frames / np.maximum(np.linalg.norm(frames, axis=1, keepdims=True), 1e-12)
    out = np.zeros(n)
    for i in range(KERNEL, n - KERNEL):
        part = unit[i - KERNEL : i + KERNEL]
        out[i] = float(((part @ part.T) * kernel).sum())
    return np.maximum(out, 0)


def peaks(curve: np.ndarray, gap: int, sigma: float = 1.0, floor: float = 0.0) -> list[int]:
    """Places, but the first and the last, that are over mean + sigma deviations (and `floor`), no lower than the one before and
    higher than the one behind; the strongest first, none within `gap` of a stronger one."""
    if len(curve) < 3:
        return []
    least = max(curve.mean() + sigma * curve.std(), floor)
    inner = curve[1:-1]
    found = 1 + np.flatnonzero((inner > least) & (inner >= curve[:-2]) & (inner > curve[2:]))
    kept: list[int] = []
    for i in found[np.argsort(-curve[found], kind="stable")]:
        if all(abs(int(i) - j) >= gap for j in kept):
            kept.append(int(i))
    return sorted(kept)


def sections(x: np.ndarray, rate: int) -> list[float] | None:
    """Starts of sections in ms, the first 0; None under 30 s, with few frames, or without a boundary."""
    at, frames = chromagram(x, rate)
    if len(x) < 30 * rate or len(frames) < 128:
        return None
    fps, whole = rate / CHROMA_HOP, len(x) / rate
    k = np.arange(2 * KERNEL) - KERNEL + 0.5
    perfect = np.exp(-(k[:, None] ** 2 + k[None, :] ** 2) / (2 * (KERNEL / 2) ** 2)).sum() / 2
    found = [at[i] / fps for i in peaks(novelty(frames), round(SECTION_S * fps), 1.0, 0.1 * perfect)]
    inner = [t * 1000 for t in found if SECTION_S < t < whole - SECTION_S]
    return [0.0, *inner] if inner else None


def loudness(x: np.ndarray, rate: int) -> float | None:
    """Integrated loudness (ITU-R BS.1770, gated) of a mono signal in LUFS; None under 10 s or in silence."""
    x = np.asarray(x, float)
    if len(x) < 10 * rate or not np.any(x):
        return None
    # both K-weighting stages as one response in the frequency domain, per block of the spectrum
    z = np.exp(-2j * np.pi * np.fft.rfftfreq(len(x)))

    def stage(f0: float, q: float, gain: float | None) -> np.ndarray:
        k = np.tan(np.pi * f0 / rate)
        a0 = 1 + k / q + k * k
        a = np.array([1, 2 * (k * k - 1) / a0, (1 - k / q + k * k) / a0])
        if gain is None:
            b = np.array([1.0, -2.0, 1.0])
        else:
            vh = 10 ** (gain / 20)
            vb = vh**0.4996667741545416
            b = np.array([vh + vb * k / q + k * k, 2 * (k * k - vh), vh - vb * k / q + k * k]) / a0
        return (b[0] + b[1] * z + b[2] * z * z) / (a[0] + a[1] * z + a[2] * z * z)

    y = np.fft.irfft(np.fft.rfft(x) * stage(1681.974450955533, 0.7071752369554196, 3.999843853973347) * stage(38.13547087602444, 0.5003270373238773, None), len(x))
    n, hop = int(0.4 * rate), int(0.1 * rate)
    total = np.concatenate(([0], np.cumsum(y * y)))
    start = np.arange(0, len(y) - n + 1, hop)
    power = (total[start + n] - total[start]) / n
    level = -0.691 + 10 * np.log10(np.maximum(power, 1e-15))
    loud = power[level > -70]
    if not len(loud):
        return None
    gate = -0.691 + 10 * np.log10(loud.mean()) - 10
    loud = power[(level > -70) & (level > gate)]
    return float(-0.691 + 10 * np.log10(loud.mean()))


def resample_linear(x: np.ndarray, rate: int, to: int = 16_000) -> np.ndarray:
    n = int(np.floor(len(x) * to / rate + 0.5))
    return np.interp(np.arange(n) * rate / to, np.arange(len(x)), x).astype(np.float32) if len(x) else np.zeros(0, np.float32)


def resample_nearest(x: np.ndarray, rate: int, to: int) -> np.ndarray:
    return x[np.minimum((np.arange(int(len(x) * to / rate)) * rate / to).astype(int), len(x) - 1)] if len(x) else x


def overlap_add(parts: list[np.ndarray], hop: int) -> np.ndarray:
    """Segments of equal length put together every `hop` with linear fades, over the sum of the fades."""
    if not parts:
        return np.zeros(0)
    n = len(parts[0])
    fade = np.minimum(1.0, np.minimum(np.arange(1, n + 1), np.arange(n, 0, -1)) / max(1, n - hop))
    out, weight = np.zeros(hop * (len(parts) - 1) + n), np.zeros(hop * (len(parts) - 1) + n)
    for k, p in enumerate(parts):
        out[k * hop : k * hop + n] += p * fade
        weight[k * hop : k * hop + n] += fade
    return out / np.maximum(weight, 1e-8)


def transition(n: int, overlap: int) -> np.ndarray:
    """Weights of a segment: linear from 0 to 1 over `overlap` samples (at most half of it), and back."""
    t = min(overlap, n // 2)
    ramp = np.arange(t) / (t - 1) if t > 1 else np.ones(t)
    return np.concatenate((ramp, np.ones(n - 2 * t), ramp[::-1]))


def through_segments(x: np.ndarray, work, size: int = SEGMENT, overlap: int = SEGMENT // 4) -> np.ndarray:
    """work(segment of `size`) on overlapping segments, the last filled up with zeros, and their weighted mean.

    The first sample has no weight and is 0, and so is the last one where a segment ends with it.
    """
    out, weight, w = np.zeros(len(x)), np.zeros(len(x)), transition(size, overlap)
    for start in range(0, max(1, len(x) - overlap) if len(x) else 0, size - overlap):
        n = min(size, len(x) - start)
        out[start : start + n] += np.asarray(work(np.pad(x[start : start + n], (0, size - n))))[:n] * w[:n]
        weight[start : start + n] += w[:n]
    return out / np.maximum(weight, 1e-8)


def log_mel(x: np.ndarray, rate: int = 16_000, mels: int = 80, fft: int = 400, hop: int = 160) -> np.ndarray:
    """(mels, frames): Slaney's scale, power, base 10, at most 8 below the peak, shifted and scaled by 4."""
    def mel(f):
        return np.where(f < 1000, f * 3 / 200, 15 + np.log(np.maximum(f, 1e-9) / 1000) * 27 / np.log(6.4))

    def hertz(m):
        return np.where(m < 15, m * 200 / 3, 1000 * np.exp((m - 15) * np.log(6.4) / 27))

    edge = hertz(np.linspace(mel(np.array(0.0)), mel(np.array(rate / 2)), mels + 2))
    f = np.fft.rfftfreq(fft, 1 / rate)
    up, down = (f[None] - edge[:-2, None]) / np.diff(edge)[:-1, None], (edge[2:, None] - f[None]) / np.diff(edge)[1:, None]
    bank = np.maximum(0, np.minimum(up, down)) * (2 / (edge[2:] - edge[:-2]))[:, None]
    y = np.pad(np.asarray(x, float), fft // 2, mode="reflect")
    frames = np.lib.stride_tricks.sliding_window_view(y, fft)[::hop][: len(x) // hop]
    power = np.abs(np.fft.rfft(frames * np.hanning(fft + 1)[:-1], axis=1)) ** 2
    out = np.log10(np.maximum(bank @ power.T, 1e-10))
    return (np.maximum(out, out.max() - 8) + 4) / 4 if out.size else out


def filter_bank(x: np.ndarray, rate: int = 16_000, mels: int = 80) -> np.ndarray:
    """(frames, mels): Kaldi's recipe of 25 ms frames every 10 ms, less each bin's mean."""
    n, hop, fft = rate // 40, rate // 100, 512
    if len(x) < n:
        return np.zeros((0, mels))
    frames = np.lib.stride_tricks.sliding_window_view(np.asarray(x, float) * 32768, n)[::hop]
    frames = frames - frames.mean(1, keepdims=True)
    frames = frames - 0.97 * np.concatenate((frames[:, :1], frames[:, :-1]), 1)
    power = np.abs(np.fft.rfft(frames * np.hamming(n), fft, axis=1)) ** 2
    mel = lambda f: 1127 * np.log(1 + f / 700)
    edge = np.linspace(mel(20.0), mel(rate / 2), mels + 2)
    m = mel(np.fft.rfftfreq(fft, 1 / rate))
    bank = np.maximum(0, np.minimum((m[None] - edge[:-2, None]) / (edge[1] - edge[0]), (edge[2:, None] - m[None]) / (edge[1] - edge[0])))
    out = np.log(np.maximum(power[:, : fft // 2] @ bank[:, : fft // 2].T, 1e-10))
    return out - out.mean(0)


def shown_spectra(frames: np.ndarray) -> np.ndarray:
    """Frames of 1024 samples in order -> 512 levels each, 0 to 255: smoothed over frames, relative to a peak that decays."""
    level = np.abs(np.fft.rfft(np.asarray(frames, float) * np.blackman(1024), axis=1))[:, :512] if len(frames) else np.zeros((0, 512))
    out, held, top = np.zeros(level.shape, np.uint8), np.zeros(512), SPECTRUM_FLOOR
    for k, own in enumerate(level):
        held = SPECTRUM_SMOOTH * held + (1 - SPECTRUM_SMOOTH) * own
        top = held.max() if held.max() > top else SPECTRUM_DECAY * top
        out[k] = np.clip(held / max(top, SPECTRUM_FLOOR) * 255, 0, 255)
    return out
