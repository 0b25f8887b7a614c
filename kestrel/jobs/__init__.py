"""Jobs from the lake to published results."""
