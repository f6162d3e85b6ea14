"""Reading folders, timed texts, samples and caches; writing samples and documents; the journal of unfinished work."""

from .files import (
    JOB, _children, all_documents, audio_files, compact_documents, framed, get_document, import_lrc, journal_finish, journal_start, journal_take, listed_files, pcm_name, put_documents, read_documents, read_index, read_pcm, read_wav,
    unframed, verified, write_documents, write_pcm,
)

from .formats import folder_changes, read_chunks, read_frames, register, write_samples

__all__ = [
    "JOB", "all_documents", "audio_files", "compact_documents", "folder_changes", "framed", "get_document", "import_lrc", "journal_finish", "journal_start", "journal_take", "listed_files", "pcm_name", "put_documents", "read_documents", "read_index",
    "read_chunks", "read_frames", "read_pcm", "read_wav", "register", "unframed", "verified", "write_documents", "write_pcm", "write_samples",
]
