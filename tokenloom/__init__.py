"""tokenloom: language-model data and tensor-relational analytics on Spark."""
