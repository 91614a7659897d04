"""Part of matrixlake; see the modules."""
