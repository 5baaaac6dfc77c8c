"""Streaming ingestion of wave files.

The study has no streams, windows or late data; nothing stateful is built.
The harmonise step is a stateless projection plus filter, so the same
operator applies unchanged to a Structured Streaming source: new wave files
dropped into a folder are harmonised and appended to the combined table.
"""

from wavestat.streaming.waves import append_waves_stream, harmonize_wave_stream  # noqa: F401
