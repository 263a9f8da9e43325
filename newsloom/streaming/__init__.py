"""Incremental jobs on Structured Streaming.

Progress lives in the stream's checkpoint, results are written under the number of the
micro-batch, so a batch that is repeated after a failure replaces itself.
"""
