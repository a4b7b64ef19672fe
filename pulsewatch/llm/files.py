"""Tables in the shared folder, read by tasks."""

import pyarrow.parquet as pq
from pyarrow import fs

from pulsewatch.sources.files import place


def parquet_batches(uri, columns, rows):
    """Record batches of at most `rows` rows of a table Spark has written, file by file; none without a folder."""
    system, path = place(uri)
    found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
    for name in sorted(f.path for f in found if f.path.endswith(".parquet")):
        with system.open_input_file(name) as file:
            yield from pq.ParquetFile(file).iter_batches(batch_size=rows, columns=columns)
