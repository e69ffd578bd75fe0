"""Readers of message, conversation, flow, probe, label, register-map and capture files, and sinks."""
