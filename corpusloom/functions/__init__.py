"""Column functions and the small Arrow kernels behind them."""
