"""Looking at physical plans, and cutting lineage."""
