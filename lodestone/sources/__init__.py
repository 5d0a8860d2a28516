"""Tables and what is known about them."""
