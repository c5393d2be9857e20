"""Streaming.

The source system has no streams, watermarks, windows over time or state
stores: every operator is a batch query over the shop tables. Nothing is
built here on purpose. The batch posting operators in
``shoptally.operators.posting`` are pure DataFrame functions, so a caller
that receives requests continuously can run them per micro-batch from
``writeStream.foreachBatch`` without any change.
"""
