from starlayer.streaming.stream_ops import (  # noqa: F401
    read_table_stream,
    stream_dwd_latest,
    stream_dws_1d,
    stream_scd2,
    run_available_now,
)
