"""Explicit schemas of the tables that cross module boundaries (DDL strings)."""

CLIPS = "clip_id string, sample_rate int, pcm binary"
CHUNKS = (
    "stream_id bigint, seq bigint, samples array<float>, sample_rate int, end_of_stream boolean, ts timestamp"
)
RAW_CHUNKS = "stream_id bigint, seq bigint, pcm binary, sample_rate int, end_of_stream boolean, ts timestamp"
EVENTS = (
    "stream_id bigint, analysis bigint, timestamp double, emitted_at_s double, event_type string, speech_active boolean, "
    "start_s double, end_s double, speaker_id int, confidence float, message string"
)
