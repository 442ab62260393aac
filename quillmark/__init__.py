"""Text fidelity and style analytics on Spark."""
