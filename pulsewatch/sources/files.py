"""Files in the shared folder, opened from tasks by their URI (local mounts, HDFS and object stores)."""

import sys

from pyarrow import fs
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def place(uri):
    """(file system, path) of a URI; `file:/x` and plain paths are local."""
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def names_in(system, path):
    """Names of the files in a folder; none where there is no folder."""
    found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted(f.base_name for f in found if f.is_file)


def put_once(system, path, data):
    """Writes a file unless it is there; whether it was written. Readers see all of it or nothing."""
    if system.get_file_info(path).type != fs.FileType.NotFound:
        return False
    folder, _, name = path.rpartition("/")
    system.create_dir(folder, recursive=True)
    making = f"{folder}/.{name}.making"
    with system.open_output_stream(making, compression=None) as file:
        file.write(data)
    system.move(making, path)
    return True
