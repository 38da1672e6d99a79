"""Jobs that chain operators: model training and refreshes."""
