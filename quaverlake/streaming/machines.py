"""What happens to one key's samples: a state, and a step per sample. No Spark in here.

A machine names the columns it reads and gives, and the types of its state; states are flat tuples.
"""

from __future__ import annotations

from dataclasses import dataclass

NEVER = -(10**15)
# Shares by which the means of level and treble (fast, slow) and of bass follow a sample.
FAST, SLOW, BASS = 0.30, 0.02, 0.06
# A kick's least bass and rise, its strength for a rise, and what is left of it at the next sample.
KICK_BASS, KICK_RISE, KICK_GAIN, KICK_KEPT = 0.22, 0.045, 4.5, 0.66
# Treble over its mean, bass and level between which a build-up grows, and by how much it grows and falls.
BUILD_RISE, BUILD_BASS, BUILD_LEVEL, BUILD_UP, BUILD_DOWN = 0.02, 0.42, 0.06, 0.016, 0.02
# A drop's least bass and rise, and the build-up or the level over its mean that it needs.
DROP_BASS, DROP_RISE, DROP_BUILD, DROP_LEVEL = 0.38, 0.11, 0.40, 1.7
# The tempos that count as a prior.
MIN_PRIOR, MAX_PRIOR = 60, 200


class Machine:
    reads: tuple[str, ...] = ()
    gives: str = ""
    state: str = ""

    def start(self) -> tuple:
        raise NotImplementedError

    def step(self, state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        """The state after a sample, and the rows to give out."""
        raise NotImplementedError

    def finish(self, state: tuple) -> list[tuple]:
        """What is still to be given out once a key has no more samples."""
        return []


class Changes(Machine):
    """`track` when the item changes, `idle` once when it goes, `tick` for every sample of an item."""

    reads, gives, state = ("t", "item"), "t long, event string, item string", "item string, known boolean"

    def start(self):
        return (None, False)

    def step(self, state, row):
        t, item = row
        if item is None:
            return (None, True), ([(t, "idle", None)] if not state[1] or state[0] is not None else [])
        new = [(t, "track", item)] if state[0] != item else []
        return (item, True), [*new, (t, "tick", item)]


@dataclass(frozen=True)
class Polls(Machine):
    """Samples of a player: a failed poll gives nothing and changes nothing; the title is only read anew for another app or after a second."""

    refresh_ms: int = 1000
    reads = ("t", "app", "title", "failed")
    gives = "t long, app string, title string, fresh boolean"
    state = "app string, title string, read_at long"

    def start(self):
        return (None, None, NEVER)

    def step(self, state, row):
        app, title, read_at = state
        t, now, new_title, failed = row
        if failed:
            return state, []
        if now is None:
            return (None, title, read_at), [(t, None, None, False)]
        fresh = now != app or t - read_at >= self.refresh_ms
        state = (now, new_title, t) if fresh else state
        return state, [(t, now, state[1], fresh)]


@dataclass(frozen=True)
class Envelope(Machine):
    """Kicks, build-ups and drops from band levels: exponential means, and tests of a rise against them by difference."""

    kick_gap: int = 130
    drop_gap: int = 2000
    reads = ("t", "bass", "treble", "level")
    gives = "t long, kick double, build double, drop boolean"
    state = "bass double, fast double, slow double, tfast double, tslow double, kick double, build double, kicked long, dropped long"

    def start(self):
        return (0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, NEVER, NEVER)

    def step(self, state, row):
        mean, fast, slow, tfast, tslow, kick, build, kicked, dropped = state
        t, bass, treble, level = row
        fast, slow = fast + FAST * (level - fast), slow + SLOW * (level - slow)
        tfast, tslow = tfast + FAST * (treble - tfast), tslow + SLOW * (treble - tslow)
        mean += BASS * (bass - mean)
        rise, hit = bass - mean, 0.0
        if bass > KICK_BASS and rise > KICK_RISE and t - kicked > self.kick_gap:
            hit, kicked = min(1.0, KICK_GAIN * rise), t
        kick = max(KICK_KEPT * kick, hit)
        rising = tfast > tslow + BUILD_RISE and bass < BUILD_BASS and fast > BUILD_LEVEL
        build = shown = min(1.0, build + BUILD_UP) if rising else max(0.0, build - BUILD_DOWN)
        drop = bass > DROP_BASS and rise > DROP_RISE and (build > DROP_BUILD or fast > DROP_LEVEL * slow) and t - dropped > self.drop_gap
        if drop:
            dropped, build = t, 0.0
        return (mean, fast, slow, tfast, tslow, kick, build, kicked, dropped), [(t, kick, shown, drop)]


@dataclass(frozen=True)
class TempoLock(Machine):
    """Holds a tempo once two sure readings agree and there are onsets enough; lets go when readings get unsure."""

    engage: float = 0.62
    release: float = 0.40
    onsets: int = 24
    agree: float = 0.04
    reads = ("t", "bpm", "confidence", "onsets")
    gives = "t long, locked boolean, bpm double"
    state = "locked double, last double"

    def start(self):
        return (0.0, 0.0)

    def step(self, state, row):
        locked, last = state
        t, bpm, confidence, count, prior = (*row, None)[:5]
        if prior is not None and MIN_PRIOR <= prior <= MAX_PRIOR:
            return (float(prior), last), [(t, True, float(prior))]
        sure = confidence is not None and bpm is not None and confidence >= self.engage
        if sure and last > 0 and abs(bpm - last) / last <= self.agree and count >= self.onsets:
            locked = bpm
        elif bpm is None or confidence is None or confidence < self.release:
            locked = 0.0
        return (locked, bpm if sure else 0.0), [(t, locked > 0, locked or None)]


class PriorTempoLock(TempoLock):
    """As TempoLock, but a sample's prior (BPM of the whole item, null if unknown) is held as it is, and readings do not count."""

    reads = (*TempoLock.reads, "prior")


@dataclass(frozen=True)
class PhaseLock(TempoLock):
    """As PriorTempoLock, with the beat clock: ms since the last beat, which runs on between samples while a tempo is held.

    A new lock sets the clock by the reading's phase (the time of a beat). With a prior the period stays and only the phase
    is followed: by the item's measured grid (ms since its last beat), or else by a reading's phase that is sure enough.
    """

    reads = ("t", "bpm", "confidence", "onsets", "phase", "prior", "grid")
    gives = "t long, locked boolean, bpm double, clock double"
    state = "locked double, last double, clock double, at long"

    def start(self):
        return (0.0, 0.0, 0.0, 0)

    def step(self, state, row):
        locked, last, clock, at = state
        t, bpm, confidence, count, phase, prior, grid = row
        clock = (clock + t - at) % (60_000 / locked) if locked > 0 else 0.0
        if prior is not None and MIN_PRIOR <= prior <= MAX_PRIOR:
            locked, period = float(prior), 60_000 / prior
            if grid is not None:
                clock = grid % period
            elif phase is not None and confidence is not None and confidence >= self.release:
                clock = (t - phase) % period
            else:
                clock %= period
        else:
            sure = confidence is not None and bpm is not None and confidence >= self.engage
            if sure and last > 0 and abs(bpm - last) / last <= self.agree and count >= self.onsets:
                locked = bpm
                clock = (t - phase) % (60_000 / bpm) if phase is not None else clock
            elif bpm is None or confidence is None or confidence < self.release:
                locked = 0.0
            last = bpm if sure else 0.0
        return (locked, last, clock, t), [(t, locked > 0, locked or None, clock if locked > 0 else None)]


@dataclass(frozen=True)
class Easing(Machine):
    """Follows rise times imminence with a time constant of 260 ms."""

    constant_ms: float = 260.0
    reads = ("t", "rise", "imminence")
    gives = "t long, eased double"
    state = "at long, value double"

    def start(self):
        return (NEVER, 0.0)

    def step(self, state, row):
        at, value = state
        t, rise, imminence = row
        share = 1.0 if at == NEVER else min(1.0, max(0.0, (t - at) / self.constant_ms))
        value += (min(1.0, 1.35 * rise) * imminence - value) * share
        return (t, value), [(t, value)]


@dataclass(frozen=True)
class Recorder(Machine):
    """Counts samples up to 12 minutes of the first batch's rate; batches of another rate are left out.

    A row per batch says how much of it is kept; `kept` over all batches under `least_s` seconds means: discard.
    """

    most_s: int = 720
    reads = ("t", "samples", "rate")
    gives = "t long, kept long, total long, full boolean"
    state = "rate long, total long"

    def start(self):
        return (0, 0)

    def step(self, state, row):
        rate, total = state
        t, n, r = row
        rate = rate or r
        kept = max(0, min(n, rate * self.most_s - total)) if r == rate else 0
        return (rate, total + kept), [(t, kept, total + kept, total + kept >= rate * self.most_s)]


class RecordSlot(Machine):
    """One recording at a time: a start claims the slot, a newer item undoes it, stop discards and flush keeps."""

    reads, gives, state = ("t", "action", "item"), "t long, event string, item string", "item string"

    def start(self):
        return (None,)

    def step(self, state, row):
        (held,), (t, action, item) = state, row
        if action == "start":
            if held == item:
                return (held,), []
            return (item,), ([(t, "undone", held)] if held is not None else []) + [(t, "claimed", item)]
        if held is None:
            return (None,), []
        return (None,), [(t, "kept" if action == "flush" else "discarded", held)]


#: Onsets fire so far over a floor, are armed again so near to it, and the floor follows a sample by this share.
ONSET, REARM, FOLLOW = 0.12, 0.048, 0.1
#: Speech begins at the one probability and ends below the other for so long; shorter spans don't count.
SPEECH, SILENCE, SPEECH_MS, SILENCE_MS = 0.5, 0.35, 250, 100


@dataclass(frozen=True)
class Onsets(Machine):
    """Numbers of the samples at which an envelope rises over its floor."""

    reads = ("t", "id", "v")
    gives = "place long"
    state = "floor double, armed boolean, i long"

    def start(self):
        return (0.0, True, 0)

    def step(self, state, row):
        floor, armed, i = state
        over = row[2] - floor
        fire = armed and over > ONSET
        return (floor + FOLLOW * over, not fire and (armed or row[2] <= floor + REARM), i + 1), [(i,)] if fire else []


@dataclass(frozen=True)
class Speech(Machine):
    """Spans of speech in probabilities that are `step_ms` apart."""

    step_ms: int
    reads = ("t", "id", "p")
    gives = "start_ms long, end_ms long"
    state = "since long, quiet long, at long"

    def start(self):
        return (None, None, 0)

    def step(self, state, row):
        since, quiet, at = state
        p, following = row[2], at + self.step_ms
        if p >= SPEECH:
            return (at if since is None else since, None, following), []
        if p >= SILENCE or since is None:
            return (since, quiet, following), []
        quiet = at if quiet is None else quiet
        if at - quiet < SILENCE_MS:
            return (since, quiet, following), []
        return (None, None, following), self._long(since, quiet)

    def finish(self, state):
        return [] if state[0] is None else self._long(state[0], state[2])

    @staticmethod
    def _long(start: int, end: int) -> list[tuple]:
        return [(start, end)] if end - start > SPEECH_MS else []


@dataclass(frozen=True)
class Padding(Machine):
    """Spans widened by `pad`, not over 0 and `total`; where two would meet, the middle divides them, seen from the span before as it is by then."""

    pad: int
    reads = ("start_ms", "end_ms", "total")
    gives = "start_ms long, end_ms long"
    state = "start long, end long, total long"

    def start(self):
        return (None, None, None)

    def step(self, state, row):
        start, end, total = state
        own, stop, whole = row
        left = max(0, own - self.pad)
        if start is None:
            return (left, stop, whole), []
        gap = max(0, own - end)
        until = max(start, end + gap // 2 if gap < 2 * self.pad else min(end + self.pad, total))
        if left < until:
            left = until = (until + own) // 2
        return (left, stop, total), [(start, until)]

    def finish(self, state):
        start, end, total = state
        return [] if start is None else [(start, max(start, min(end + self.pad, total)))]


@dataclass(frozen=True)
class Windows(Machine):
    """Windows of at most `width` over spans in order; a span that is too long is cut."""

    width: int
    reads = ("start_ms", "end_ms")
    gives = "start_ms long, end_ms long"
    state = "start long, end long"

    def start(self):
        return (None, None)

    def step(self, state, row):
        (start, end), (at, stop), out = state, row, []
        if start is not None:
            if stop <= start + self.width:
                return (start, stop), []
            if at < start + self.width:
                end = start + self.width
            at = max(end, at)
        while at < stop:
            if start is not None:
                out.append((start, end))
            start, end = at, min(at + self.width, stop)
            at = end
        return (start, end), out

    def finish(self, state):
        return [] if state[0] is None else [state]


@dataclass(frozen=True)
class Spaced(Machine):
    """The samples that lie over `gap` after the last one given out."""

    gap: float
    reads = ("t", "v")
    gives = "t double, v double"
    state = "last double"

    def start(self):
        return (None,)

    def step(self, state, row):
        return (state, []) if state[0] is not None and row[0] - state[0] <= self.gap else ((row[0],), [row])
