"""peerlens: company benchmarking and corpus analytics as Spark DataFrame operators."""
