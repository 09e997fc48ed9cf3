"""Generate, load and keep current the eight TPC-H-shaped tables on Spark."""
