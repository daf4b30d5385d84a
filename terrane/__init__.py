"""PySpark analytics for judging text embeddings by the shape of their point clouds."""
