"""Per-image kernels in numpy: what a task does with each image of its Arrow batches."""
