"""textledger: searching, versioning and reconciling large text collections as Spark jobs."""
