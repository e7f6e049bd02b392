"""Readers and writers: captions, speech-to-text output, metadata, job logs, detector output."""
