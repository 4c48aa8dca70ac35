"""A stand-in for models with layers and components, for the batch operators."""

import numpy as np

from polyprobe.sources.driver_tables import HIDDEN_LAYERS, N_LAYERS, WIDTH, _letter_waves


def load_layers():
    return lambda prompts: np.stack([[_letter_waves(p, float(layer)) for layer in range(N_LAYERS)] for p in prompts])


def load_hidden():
    def hidden_states(prompt: str) -> np.ndarray:
        codes, at = np.unique([ord(c) for c in prompt], return_inverse=True)
        waves = np.outer(codes, np.arange(1, WIDTH + 1) / WIDTH)
        return np.stack([10.0 * np.cos(waves + layer)[at] for layer in range(HIDDEN_LAYERS + 1)])

    return hidden_states


COMPONENTS = ("block_2", "attn", "block_1", "mlp")


def load_components():
    def run(prompts):
        return np.stack([
            [[_letter_waves(p, layer + 0.25 * c) for layer in range(HIDDEN_LAYERS)] for c in range(len(COMPONENTS))]
            for p in prompts
        ])

    return run
