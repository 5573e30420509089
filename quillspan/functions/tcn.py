"""Forward pass of a temporal convolutional network in numpy, for windows in Arrow batches; no training."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


Layer = tuple[np.ndarray, np.ndarray]  # kernel (width, channels in, channels out) and bias


@dataclass
class Network:
    """Weights by layer: the first 1x1 convolution, a dilated one and a 1x1 one per block, the softmax head."""

    first: Layer
    blocks: list[tuple[Layer, Layer]] = field(default_factory=list)
    dilations: list[int] = field(default_factory=list)
    head: Layer | None = None
    activation: str = "norm_relu"
    skips: bool = True
    front: tuple[int, int] | None = None  # transform length and hop of a spectrogram before the network
    upsample: bool = True


def make(channels: int, filters: int, classes: int, width: int = 3, dilations: tuple[int, ...] = (1, 2, 4, 8), stacks: int = 1, seed: int = 0, front: tuple[int, int] | None = None, **options) -> Network:
    """A network of small random weights, a function of the seed; with `front`, the transform's bins are its channels."""
    rng = np.random.default_rng(seed)
    layer = lambda w, a, b: (rng.normal(0, (w * a) ** -0.5, (w, a, b)), np.zeros(b))
    bins = channels * (front[0] // 2 + 1) if front else channels
    net = Network(layer(1, bins, filters), front=front, **options)
    for _ in range(stacks):
        for d in adjusted(list(dilations)):
            net.blocks.append((layer(width, filters, filters), layer(1, filters, filters)))
            net.dilations.append(d)
    net.head = layer(1, filters, classes)
    return net


def receptive_field(width: int, stacks: int, last_dilation: int) -> int:
    """Samples that one output sees, by the usual formula."""
    return width * stacks * last_dilation


def adjusted(dilations: list[int]) -> list[int]:
    """Dilations as powers of two: kept where all are, else taken as exponents."""
    return list(dilations) if all(d > 0 and d & (d - 1) == 0 for d in dilations) else [2**d for d in dilations]


def conv(x: np.ndarray, kernel: np.ndarray, dilation: int, causal: bool = True) -> np.ndarray:
    """Dilated convolution of (time, channel) with zero padding to the same length."""
    width = len(kernel)
    reach = (width - 1) * dilation
    left = reach if causal else reach // 2
    wide = np.pad(x, ((left, reach - left), (0, 0)))
    return sum(wide[k * dilation : k * dilation + len(x)] @ kernel[k] for k in range(width))


def normalised(x: np.ndarray) -> np.ndarray:
    """Each moment over its largest absolute channel."""
    return x / (np.abs(x).max(axis=1, keepdims=True) + 1e-5)


def activated(x: np.ndarray, kind: str) -> np.ndarray:
    """norm_relu, wavenet (tanh times sigmoid), relu, tanh or linear."""
    if kind == "norm_relu":
        return normalised(np.maximum(x, 0))
    if kind == "wavenet":
        return np.tanh(x) / (1 + np.exp(-x))
    return {"relu": lambda v: np.maximum(v, 0), "tanh": np.tanh, "linear": lambda v: v}[kind](x)


def residual_block(x: np.ndarray, block: tuple[Layer, Layer], dilation: int, activation: str = "norm_relu", causal: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(input plus the block's output, the output): dilated convolution, activation, 1x1 convolution."""
    (kernel, bias), (side, side_bias) = block
    made = conv(activated(conv(x, kernel, dilation, causal) + bias, activation), side, 1, causal) + side_bias
    return x + made, made


def spectrogram_front(x: np.ndarray, n_dft: int, hop: int) -> np.ndarray:
    """(frame, bin * channel): decibels of the amplitude of Hann-windowed frames, `same` padding, relative to the largest, cut at -80."""
    n = -(-len(x) // hop)
    need = max((n - 1) * hop + n_dft - len(x), 0)
    wide = np.pad(x, ((need // 2, need - need // 2), (0, 0)))
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n_dft) / n_dft)
    frames = np.stack([wide[k * hop : k * hop + n_dft] * window[:, None] for k in range(n)])
    db = 10 * np.log10(np.maximum(np.abs(np.fft.rfft(frames, axis=1)), 1e-10))
    return np.maximum(db - db.max(), -80.0).reshape(n, -1)


def forward(net: Network, x: np.ndarray, causal: bool = False) -> np.ndarray:
    """(time, class) probabilities of (time, channel) input.

    A 1x1 convolution, residual blocks, the sum of their outputs (without skips the last block's
    sum), relu, dense softmax. With a front, the network runs on its frames and the result is
    repeated to the input's rate.
    """
    if not len(x):
        return np.zeros((0, net.head[0].shape[2]))
    n = len(x)
    if net.front:
        x = spectrogram_front(x, *net.front)
    x = conv(x, net.first[0], 1, causal) + net.first[1]
    outputs = 0.0
    for block, dilation in zip(net.blocks, net.dilations):
        x, made = residual_block(x, block, dilation, net.activation, causal)
        outputs = outputs + made
    z = conv(np.maximum(outputs if net.skips else x, 0), net.head[0], 1) + net.head[1]
    z = np.exp(z - z.max(axis=1, keepdims=True))
    p = z / z.sum(axis=1, keepdims=True)
    return np.repeat(p, net.front[1], axis=0)[:n] if net.front and net.upsample else p


def tcn(channels: int, classes: int, filters: int = 16, width: int = 3, dilations: tuple[int, ...] = (1, 2, 4, 8, 16), stacks: int = 1, **options) -> Network:
    """The plain network with its published defaults."""
    return make(channels, filters, classes, width, dilations, stacks, **options)


def tcn_stft(channels: int, classes: int, pre: int = 0, n_dft: int = 64, **options) -> Network:
    """The network behind a spectrogram of hop 2**pre; pre = 0 is the plain one."""
    return tcn(channels, classes, front=(n_dft, 2**pre) if pre else None, **options)


#: Builders by name.
MODELS = {"tcn": tcn_stft, "tcn_stft": tcn_stft}


def temporal_loss(p: np.ndarray, y: np.ndarray, tau: float = 4.0) -> float:
    """Mean squared change of log probabilities over time, cut at tau."""
    d = np.diff(np.log(np.maximum(p, 1e-7)), axis=0)
    return float(np.minimum(np.abs(d), tau).__pow__(2).mean()) if len(p) > 1 else 0.0


def weighted_loss(p: np.ndarray, y: np.ndarray, smooth: float = 0.15) -> float:
    """Cross entropy and a share of the temporal loss."""
    return float(-(y * np.log(np.maximum(p, 1e-7))).sum(axis=1).mean() + smooth * temporal_loss(p, y))
