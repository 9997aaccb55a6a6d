"""Small neural networks trained data-parallel: tasks make gradients of their rows, the driver holds a model of fixed size."""
