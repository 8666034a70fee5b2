"""DataFrame operators: composable, without actions of their own."""
