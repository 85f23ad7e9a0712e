"""Private multi-table synthesis and fidelity measurement as Spark DataFrame operators."""
