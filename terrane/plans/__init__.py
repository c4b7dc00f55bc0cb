"""Plans of conditional approximations and what is evaluated on them."""
