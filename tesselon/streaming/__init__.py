"""Resumable flows as Structured Streaming."""
