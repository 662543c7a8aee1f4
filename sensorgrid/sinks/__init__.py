"""Writers."""

from sensorgrid.sinks.writers import (
    Sink,
    append_jdbc,
    append_table,
    nest_by_time,
    pending_times,
    write_csv,
    write_documents,
    write_grid_text,
    write_result,
    written_file_times,
    written_times,
)

__all__ = [
    "Sink", "append_jdbc", "append_table", "nest_by_time", "pending_times", "write_csv",
    "write_documents", "write_grid_text", "write_result", "written_file_times", "written_times",
]
