"""The engine behind HTTP and the command line; transport only, the work is in docspark.api."""
