"""Results of resampling leave a worker in small batches."""

import numpy as np
import pyarrow as pa

from framewise.functions import resample


def test_resampled_images_leave_in_small_batches(spark):
    """A batch of many short rows used to become one array of whole frames: 3000 rows gave 1.6 GB."""
    made = resample.planes_of(lambda images: np.zeros((len(images), 2, 128, 256)), 128 * 256, 2, 1)
    values = pa.array([[1.0] * 4] * 3000)
    sizes = [pa.array([n] * 3000) for n in (2, 2, 1)]
    out = list(made.func(iter([(values, *sizes)])))
    assert sum(map(len, out)) == 3000 and max(map(len, out)) <= 64
