"""claimloom: claims from documents, on Spark."""

ENGINE_VERSION = "0.1.0"
