"""State machines over keyed, ordered samples, for streams and for tables alike."""

from .machines import Changes, Easing, Envelope, Machine, Onsets, Padding, PhaseLock, Polls, PriorTempoLock, Recorder, RecordSlot, Spaced, Speech, TempoLock, Windows
from .runner import over_late_stream, over_stream, over_table, rescan_on

__all__ = [
    "Changes", "Easing", "Envelope", "Machine", "Onsets", "Padding", "PhaseLock", "Polls", "PriorTempoLock", "RecordSlot", "Recorder", "Spaced", "Speech", "TempoLock", "Windows",
    "over_late_stream", "over_stream", "over_table", "rescan_on",
]
