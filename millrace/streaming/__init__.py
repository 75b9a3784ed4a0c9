"""Durable buffers, their drain by Structured Streaming, and the HTTP host."""
