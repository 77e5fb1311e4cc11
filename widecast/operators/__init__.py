"""DataFrame operators: preparation, profiling, encoding, sampling, training, evaluation."""
