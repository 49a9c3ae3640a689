"""octetflow: binary content as DataFrames (digests, chunking, deltas, archives, codecs, images, shares)."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors with each task, so nothing need be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
