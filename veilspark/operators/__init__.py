"""DataFrame operators: budget, encoding, marginals, model, sampling, integrity, fidelity."""
