"""Request streams: JSON encode/decode, parsing with quarantine, scoring in
micro-batches, idempotent sinks."""
